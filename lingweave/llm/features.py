"""Hashed sparse features and the small parts that the linear models share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

Sparse = tuple[np.ndarray, np.ndarray]  # feature numbers, values


def nonzero(features: np.ndarray, size: int) -> Sparse:
    """Distinct feature numbers and how often each occurs."""
    counts = np.bincount(features, minlength=size)
    at = np.flatnonzero(counts)
    return at, counts[at]


def pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    return at.astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()


def unpack(data: bytes) -> Sparse:
    both = np.frombuffer(data, np.uint32)
    half = len(both) // 2
    return both[:half].astype(np.int32), both[half:].astype(np.float32)


def unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def hashed_share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def sample(rows: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the key, so the same on any cluster; all if fewer."""
    total = rows.count()
    return rows if total <= most else rows.where(hashed_share(F.col(key), salt) < most / total)


def in_order(rows: list[tuple], seed: int) -> Iterator[tuple]:
    """Rows in a seeded order that does not depend on how they arrived."""
    rows = sorted(rows)
    for i in np.random.default_rng(seed).permutation(len(rows)):
        yield rows[i]
