"""Whole Arrow columns of text as byte, word and hash arrays.

Texts stay UTF-8: every word pattern used here only tells ASCII characters apart,
and a byte of 128 or more always belongs to a word. A column is worked on in
chunks of whole texts, so memory is bounded by the chunk and the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from lingweave.session import estimated_bytes

CHUNK_BYTES = 4 << 20

# ASCII bytes outside a word of digits and letters, and ASCII white space.
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
WHITE = [0x20, *range(0x09, 0x0E)]

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def word_table(outside: Sequence[int]) -> np.ndarray:
    """True for bytes inside words."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


def lower_table() -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """64-bit hashes of byte spans by prefix sums: one pass over the bytes for any number of spans."""

    def __init__(self, seed: int = 7):
        self._bytes = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) <= n:
            size = 1 << int(n).bit_length()
            up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Hash of every ``data[start:end]``; spans are in order and do not overlap."""
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            base = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, base + block, "right")))
            part = data[base : int(ends[last - 1])]
            self._powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self._bytes[part] * self._up[: len(part)], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (sums[e] - sums[s]) * self._down[s] + (e - s).astype(np.uint64)
            first = last
        return mix(out)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of ``size`` consecutive hashes."""
        n = max(0, len(hashes) - size + 1)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[j : j + n]
        return mix(out)


@dataclass
class Chunk:
    """Some texts of a column: bytes, where each text begins, and its words."""

    first: int  # row of the first text in the batch
    data: np.ndarray  # uint8, all texts one after another
    offsets: np.ndarray  # int64, texts + 1
    starts: np.ndarray  # byte positions of words
    ends: np.ndarray
    text: np.ndarray  # number of the text of each word, from 0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of words."""
        return np.searchsorted(self.text, np.arange(self.rows + 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_blocks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of runs of whole texts of about ``limit`` bytes."""
    data, offsets = utf8(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; a word never crosses texts."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    opens[borders] |= inside[borders]
    closes[borders - 1] |= inside[borders - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, "right") - 1


def chunks(column: pa.Array, table: np.ndarray, lower: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column with their words, some whole texts at a time."""
    for first, data, offsets in text_blocks(column, limit):
        if lower is not None:
            data = lower[data]
        yield Chunk(first, data, offsets, *word_spans(data, offsets, table))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, a place where each stands, and the number of the hash at every place."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, given the first value of each."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the input; ``None`` for rows that did not come from files."""
    size = estimated_bytes(df)
    return None if size >= 1 << 56 else size


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` that also takes column names with dots, which Spark would read as paths."""
    names, own = df.columns, [f"_{i}" for i in range(len(df.columns))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*own).mapInArrow(renamed, schema)


def add_columns(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """Append columns that ``make()(batch)`` computes in each task.

    Input columns with the name of an added one are replaced, as ``withColumn`` does.
    """
    added = StructType.fromDDL(ddl)
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in added.names])
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept.schema.fields], *added.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns(batch)], names)

    return map_arrow(kept, run, schema)
