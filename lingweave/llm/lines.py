"""Line dedup: frequent lines are looked up in a sharded minimal perfect hash, documents are never joined with lines.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``least_chars`` code points
that stand in at least ``least_docs`` documents lose all their lines except in the document with the largest id.

One pass counts, per 128-bit hash of a key, the documents that hold it and their largest id; counts combine before the
shuffle. Hashes that reach ``least_docs`` (no other line can be dropped) are dealt to shards of about ``SHARD_KEYS``. A
shard is a minimal perfect hash in levels of bit arrays (Limasset et al. 2017: a key rests on the first level where it
meets no other), which numbers its keys 0, 1, 2, ... without storing them, and three arrays under that number:
fingerprint, count and largest id. Shards are files in the shared folder. A second pass over the documents hashes their
lines again and probes the arrays, shard by shard, some megabytes of text at a time; a key that is not in the index meets
a foreign fingerprint, and passes for it with probability 2 to the -64. A worker keeps ``KEPT_BYTES`` of shards, so memory
does not grow with the index. Texts are read twice and never shuffled; a task reads the shards its lines fall into.

Every row is a document. Cases: a null or empty text is one empty line and gives the empty text; rows with a repeated id
count one by one, and all rows with the largest id keep their lines; null ids are below all others, and a key held by
null ids only stays in all of them; a key that repeats inside a document counts once, and goes or stays with all its
lines; texts of any length are split whole; input columns named like an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, functions as F

from lingweave.llm.text import WHITE, Hasher, add_columns, distinct, lower_table, map_arrow, mix, text_blocks
from lingweave.session import scratch_path, stored
from pyspark.sql.types import StructType

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARD_KEYS = 250_000
ROOM = 2.0  # bits per key and level
LEVELS = 64
KEPT_BYTES = 64 << 20  # of shards in a worker

ADDED = "n_lines bigint, n_dropped bigint, text string"


def shared_folder(spark, name: str) -> str:
    """A new folder below the shared one as a URI, the same for Spark's file systems and for tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    uri = files.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri


class Lines:
    """Lines of some texts: borders, text numbers, and the hashes of the keys that are long enough."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_chars: int, hashers: tuple[Hasher, Hasher]):
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        per = np.diff(np.searchsorted(breaks, offsets)) + 1
        self.bounds = np.concatenate([[0], np.cumsum(per)])
        self.text = np.repeat(np.arange(len(per)), per)
        solid = np.ones(256, bool)
        solid[WHITE] = False
        solid_at = np.flatnonzero(solid[data])
        low, high = np.searchsorted(solid_at, self.starts), np.searchsorted(solid_at, self.ends)
        long = np.flatnonzero(high - low > 0)
        opens, closes = solid_at[low[long]], solid_at[high[long] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        enough = points[closes] - points[opens] >= least_chars
        self.line, opens, closes = long[enough], opens[enough], closes[enough]
        lowered = lower_table()[data]
        self.high, self.low = (h.spans(lowered, opens, closes) for h in hashers)


def hashers() -> tuple[Hasher, Hasher]:
    return Hasher(17), Hasher(19)


def line_counts(docs: DataFrame, key: str, text: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``high, low, n, last``: documents that hold a key, and their largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = hashers()
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in text_blocks(batch.column(1)):
                lines = Lines(data, offsets, least_chars, both)
                text_of = lines.text[lines.line]
                # once per document
                _, once, _ = distinct(mix(lines.high ^ (text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) ^ lines.low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.high[once].view(np.int64)), pa.array(lines.low[once].view(np.int64)), ids.take(pa.array(text_of[once] + first))],
                    ["high", "low", "id"],
                )

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    found = map_arrow(rows, run, StructType.fromDDL("high bigint, low bigint, id bigint"))
    return found.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall on a level."""
    mixed = mix(high * np.uint64(2 * level + 0x9E3779B97F4A7C15) ^ (low + np.uint64(level)))
    return ((mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class Shard:
    """A minimal perfect hash over some keys, and the arrays it indexes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray, null: np.ndarray):
        self.sizes, self.words, self.prints, self.counts, self.last, self.null = sizes, words, prints, counts, last, null
        # keys before every word of bits, over all levels
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self._first = np.concatenate([[0], np.cumsum(-(-sizes // 64))])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, last: np.ndarray, null: np.ndarray) -> Shard:
        sizes, words, rest = [], [], np.arange(len(high))
        while len(rest):
            if len(sizes) == LEVELS:
                raise ValueError(f"{len(rest)} keys of a shard share all their bits")
            size = max(64, int(len(rest) * ROOM))
            at = _places(high[rest], low[rest], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            padded = np.zeros(-(-size // 64) * 64, np.uint8)
            padded[:size] = alone
            sizes.append(size)
            words.append(np.packbits(padded, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        made = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]), low, counts, last, null)
        order = np.empty(len(high), np.int64)
        order[made.number(high, low)] = np.arange(len(high))
        made.prints, made.counts, made.last, made.null = low[order], counts[order], last[order], null[order]
        return made

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of every key; keys outside the index get -1 or that of another key."""
        out, rest = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, size in enumerate(self.sizes):
            at = _places(high[rest], low[rest], level, int(size))
            word, bit = self._first[level] + (at >> 6), (at & 63).astype(np.uint64)
            own = self.words[word]
            here = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[rest[here]] = self._before[word[here]] + below
            rest = rest[~here]
            if not len(rest):
                break
        return out

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of every key, -1 for those whose fingerprint differs."""
        at = self.number(high, low)
        if not len(self.prints):
            return at
        return np.where((at >= 0) & (self.prints[at] == low), at, -1)

    def save(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, sizes=self.sizes, words=self.words, prints=self.prints, counts=self.counts, last=self.last, null=self.null)
        return sink.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as a:
            return cls(*(a[n] for n in ("sizes", "words", "prints", "counts", "last", "null")))


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}"


def build_index(counts: DataFrame, folder: str, shard_keys: int = SHARD_KEYS) -> int:
    """Write one file per shard of ``high, low, n, last``; returns the number of shards.

    A file takes its name when it is whole, so a task that is run again leaves the same files.
    """
    counts = stored(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def run(table: pa.Table) -> pa.Table:
        files, base = fs.FileSystem.from_uri(folder)
        shard = table["shard"][0].as_py()
        word = lambda name: table[name].to_numpy().view(np.uint64)
        last = table["last"].fill_null(0).to_numpy()
        data = Shard.build(word("high"), word("low"), table["n"].to_numpy(), last, table["last"].is_null().to_numpy(zero_copy_only=False)).save()
        draft = f"{shard_path(base, shard)}.{np.random.default_rng().integers(1 << 62)}"
        with files.open_output_stream(draft) as out:
            out.write(data)
        files.move(draft, shard_path(base, shard))
        return pa.table({"shard": pa.array([shard], pa.int32()), "bytes": pa.array([len(data)], pa.int64())})

    top = F.shiftrightunsigned("high", 32)
    dealt = counts.withColumn("shard", F.shiftright(top * shards, 32).cast("int"))
    dealt.groupBy("shard").applyInArrow(run, "shard int, bytes bigint").agg(F.sum("bytes")).collect()
    return shards


class Index:
    """The shards of a folder; a worker keeps the last ones it used."""

    def __init__(self, folder: str, shards: int, kept: int = KEPT_BYTES):
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.shards, self.kept, self.held = shards, kept, 0
        self._open: OrderedDict[int, tuple[Shard | None, int]] = OrderedDict()

    def shard(self, number: int) -> Shard | None:
        if number in self._open:
            self._open.move_to_end(number)
            return self._open[number][0]
        path = shard_path(self.base, number)
        found, size = None, 0
        if self.files.get_file_info(path).type == fs.FileType.File:  # a shard without keys has no file
            with self.files.open_input_stream(path) as stored_shard:
                data = stored_shard.read()
            found, size = Shard.load(data), len(data)
        self._open[number] = found, size
        self.held += size
        while self.held > self.kept and len(self._open) > 1:
            self.held -= self._open.popitem(last=False)[1][1]
        return found

    def last(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is in the index, the largest id that holds it, and whether that is null."""
        known, last, null = np.zeros(len(high), bool), np.zeros(len(high), np.int64), np.zeros(len(high), bool)
        shard = shard_of(high, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            index = self.shard(int(shard[part[0]]))
            if index is not None:
                at = index.find(high[part], low[part])
                hit = at >= 0
                part, at = part[hit], at[hit]
                known[part], last[part], null[part] = True, index.last[at], index.null[at]
        return known, last, null


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Documents without their repeated lines: adds ``n_lines, n_dropped`` and replaces the text, as column ``text``."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-index")
    shards = build_index(line_counts(docs, key, text, least_chars).where(F.col("n") >= least_docs), folder, shard_keys)

    def make() -> Callable:
        both, index = hashers(), Index(folder, shards)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = batch.column(batch.schema.get_field_index("_id"))
            empty = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            lines_of, dropped_of, texts = [], [], []
            for first, data, offsets in text_blocks(batch.column(batch.schema.get_field_index("_text"))):
                lines = Lines(data, offsets, least_chars, both)
                known, last, null = index.last(lines.high, lines.low)
                row = lines.text[lines.line] + first
                holds = np.where(null, empty[row], ~empty[row] & (ids[row] == last))
                gone = np.zeros(len(lines.starts), bool)
                gone[lines.line[known & ~holds]] = True
                dropped = np.bincount(lines.text[gone], minlength=len(offsets) - 1)
                lines_of.append(np.diff(lines.bounds))
                dropped_of.append(dropped)
                raw = data.tobytes()
                for t in range(len(offsets) - 1):
                    if dropped[t]:
                        left = np.flatnonzero(~gone[lines.bounds[t] : lines.bounds[t + 1]]) + lines.bounds[t]
                        texts.append(b"\n".join([raw[s:e] for s, e in zip(lines.starts[left].tolist(), lines.ends[left].tolist())]))
                    else:
                        texts.append(raw[offsets[t] : offsets[t + 1]])
            whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
            return [whole(lines_of), whole(dropped_of), pa.array(texts, pa.binary()).cast(pa.string())]

        return columns

    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "text", text)], F.col(f"`{key}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return add_columns(own, ADDED, make).drop("_id", "_text")
