"""Reproducible uniform numbers from a seed and row keys.

``rand()`` depends on partition layout and differs after a task is retried.
These values depend on the keys alone, so a re-run, another cluster size or
another engine gives the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def digest(seed: int, tag: str, *keys: Column) -> Column:
    """Hex md5 of ``seed|tag|key|...``; also a shuffle order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in keys]))


def uniform(seed: int, tag: str, *keys: Column) -> Column:
    """A double in [0, 1) fixed by the arguments."""
    head = F.conv(F.substring(digest(seed, tag, *keys), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def below(digest: Column, probability: float) -> Column:
    """Whether the uniform number of a digest is under ``probability``.

    Hex digits of equal number sort as the numbers do, so the digest is compared as it is.
    """
    most = math.ceil(probability * 4294967296.0)
    return digest < F.lit(f"{max(most, 0):08x}" if most < 1 << 32 else "g")


def drawn(seed: int, tag: str, probability: float, *keys: Column) -> Column:
    """``uniform(...) < probability``, without making a number of it."""
    return below(digest(seed, tag, *keys), probability)
