"""Benchmark decontamination with training suffix arrays.

Each task sorts the word suffixes of its documents, shard by shard, and binary-searches
every suffix of the benchmark texts in them. A range of the suffix array is the set of
all locations of a match, and the last word that still has a range is its length. No
document is shuffled. The benchmark travels in blocks of a checked size; each block is
one more map over the documents in the same stage.

Cases: a null or empty text has no words, so no hits and no windows; an item without
words has no window; an item with null ``item_id`` hits but is not listed; repeated item
ids are listed once; repeated or null ``doc_id`` are separate rows, since no step uses
the id; empty tables give no rows, and an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm.text import NOT_ALNUM, Hasher, add_columns, chunks, distinct, lower_table, word_table

WINDOW = 13  # words of a window
HIT_SHARE = 20  # contaminated: one word in this many is hit
SHARD_BYTES = 4 << 20  # text of one suffix array
BLOCK_BYTES = 32 << 20  # benchmark text sent to the tasks at once

ADDED = "n_words bigint, hits array<struct<word:bigint,n_words:bigint>>, item_ids array<bigint>, longest_match bigint"


@dataclass
class Items:
    """Benchmark texts as one row of word hashes."""

    ids: list  # item ids, may hold null
    words: np.ndarray  # uint64
    item: np.ndarray  # item number of each word
    end: np.ndarray  # end of the item of each word

    @classmethod
    def of(cls, ids: list, texts: pa.Array) -> Items:
        hasher, words, item = Hasher(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c in chunks(texts, word_table(NOT_ALNUM), lower_table()):
            words.append(hasher.spans(c.data, c.starts, c.ends))
            item.append(c.text + c.first)
        item = np.concatenate(item)
        return cls(ids, np.concatenate(words), item, np.searchsorted(item, item, "right"))

    def windows(self, size: int) -> np.ndarray:
        """Window length at each word, 0 where none begins."""
        place = np.arange(len(self.words))
        begins = np.searchsorted(self.item, self.item, "left")
        whole = (place == begins) & (self.end - begins < size)
        return np.where(self.end - place >= size, size, np.where(whole, self.end - begins, 0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Start of every suffix, sorted by its first ``depth`` ids at least.

    Several ids are packed for the first sort. Later sorts double the length and
    touch only suffixes that are still equal.
    """
    n, base = len(ids), int(ids.max(initial=0)) + 1
    if n == 0:
        return np.zeros(0, np.int64)
    packed = max(1, min(depth, int(62 // np.log2(max(base, 2)))))
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key *= base
        key[: n - j] += ids[j:]
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    open_at = places[~(first & np.append(first[1:], True))]  # places of suffixes that are still equal
    length = packed
    while length < depth and len(open_at):
        group = order[open_at]
        ahead = group + length
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[group] * (n + 1) + after
        by = np.argsort(key)
        order[open_at] = group = group[by]
        key = key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        rank[group] = open_at[starts]
        open_at = open_at[~(first & np.append(first[1:], True))]
        length *= 2
    return order


def _bound(ids: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """First place in ``[low, high)`` whose id at ``depth`` is not below (``right``: is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) >> 1
        at = order[middle] + depth
        seen = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], 0)
        below = seen <= want[live] if right else seen < want[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
    return low


def search(ids: np.ndarray, order: np.ndarray, query: np.ndarray, end: np.ndarray, window: np.ndarray):
    """Binary search of all query suffixes at once, a word further with every step.

    Returns the length of the longest match of each suffix and one location, and the
    ranges of the suffix array that hold the suffix's window.
    """
    q = len(query)
    longest, where = np.zeros(q, np.int64), np.zeros(q, np.int64)
    window_low, window_high = np.zeros(q, np.int64), np.zeros(q, np.int64)
    live = np.flatnonzero(query > 0)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(ids), np.int64)
    depth = 0
    while live.size:
        want = query[live + depth]
        low = _bound(ids, order, depth, low, high, want, False)
        high = _bound(ids, order, depth, low, high, want, True)
        found = low < high
        live, low, high = live[found], low[found], high[found]
        depth += 1
        longest[live] = depth
        where[live] = order[low]
        full = window[live] == depth
        window_low[live[full]], window_high[live[full]] = low[full], high[full]
        more = live + depth < end[live]
        more[more] &= query[live[more] + depth] > 0
        live, low, high = live[more], low[more], high[more]
    return longest, where, window_low, window_high


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range, and place, of every member of the ranges."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


@dataclass
class Shard:
    """The suffix array of some documents."""

    chunk: object
    bounds: np.ndarray
    vocabulary: np.ndarray
    place: np.ndarray  # place of each word in ``ids``
    ids: np.ndarray  # word ranks; 0 after every document, so that no match crosses documents
    order: np.ndarray

    @classmethod
    def of(cls, chunk, hasher: Hasher, depth: int) -> Shard:
        vocabulary, _, rank = distinct(hasher.spans(chunk.data, chunk.starts, chunk.ends))
        place = np.arange(len(rank)) + chunk.text
        ids = np.zeros(len(rank) + chunk.rows, np.int64)
        ids[place] = rank + 1
        return cls(chunk, chunk.bounds(), vocabulary, place, ids, suffix_array(ids, depth))

    def query(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, words)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == words[known]
        return np.where(known, at + 1, 0)

    def document(self, place: np.ndarray) -> np.ndarray:
        """Document of places that hold words."""
        return np.searchsorted(self.bounds[1:] + np.arange(self.chunk.rows), place, "right")


def _runs(covered: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of every maximal run of covered places."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    document = shard.document(starts)
    return document, starts - (shard.bounds[:-1] + np.arange(shard.chunk.rows))[document], ends - starts


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _shard_hits(shard: Shard, items: Items, window: np.ndarray):
    longest, where, low, high = search(shard.ids, shard.order, shard.query(items.words), items.end, window)
    full = np.flatnonzero(high > low)
    which, places = _expand(low[full], high[full])
    at, size = shard.order[places], window[full][which]
    marks = np.zeros(len(shard.ids) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    pairs = np.unique(shard.document(at) * len(items.ids) + items.item[full][which]) if len(at) else np.zeros(0, np.int64)
    best = np.zeros(shard.chunk.rows, np.int64)
    # longest match per document: the ranges above hold every location of a window
    if len(at):
        np.maximum.at(best, shard.document(at), size)
        seen = np.flatnonzero(longest >= np.maximum(window, 1))
        np.maximum.at(best, shard.document(where[seen]), longest[seen])
    return np.cumsum(marks[:-1]) > 0, pairs, best


def _columns(items: Items, window_size: int):
    window, hasher = items.windows(window_size), Hasher()
    depth = int((items.end - np.arange(len(items.words))).max(initial=1))
    item_ids = np.array([-1 if x is None else x for x in items.ids], np.int64)
    named = np.array([x is not None for x in items.ids], bool)

    def columns(texts: pa.Array) -> list[pa.Array]:
        words, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        run_rows, run_starts, run_sizes, id_rows, ids = ([np.zeros(0, np.int64)] for _ in range(5))
        for chunk in chunks(texts, word_table(NOT_ALNUM), lower_table(), SHARD_BYTES):
            rows = slice(chunk.first, chunk.first + chunk.rows)
            shard = Shard.of(chunk, hasher, depth)
            words[rows] = np.diff(shard.bounds)
            covered, pairs, longest[rows] = _shard_hits(shard, items, window)
            row, start, size = _runs(covered, shard)
            run_rows, run_starts, run_sizes = [*run_rows, row + chunk.first], [*run_starts, start], [*run_sizes, size]
            if len(pairs):
                row, item = np.divmod(pairs, len(items.ids))
                row, item = row[named[item]], item[named[item]]
                unique = np.unique(np.stack([row, item_ids[item]], 1), axis=0)
                id_rows, ids = [*id_rows, unique[:, 0] + chunk.first], [*ids, unique[:, 1]]
        count = lambda rows: np.bincount(np.concatenate(rows), minlength=len(texts))
        spans = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(run_starts), pa.int64()), pa.array(np.concatenate(run_sizes), pa.int64())], ["word", "n_words"]
        )
        return [
            pa.array(words),
            _lists(count(run_rows), spans),
            _lists(count(id_rows), pa.array(np.concatenate(ids), pa.int64())),
            pa.array(longest),
        ]

    return columns


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of about ``limit`` bytes; only one is on the driver at a time."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    block = F.pmod(F.xxhash64(item_id, text), F.lit(blocks))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(block == b)
        table = part.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).toArrow().sort_by("id")
        yield Items.of(table["id"].to_pylist(), table["text"].combine_chunks().cast(pa.string()))


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``hits`` (runs of hit words), ``item_ids`` and ``longest_match`` (at least a window) to documents."""
    sc = docs.sparkSession.sparkContext
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = sc.broadcast(astuple(block))  # plain arrays: executors need no copy of the class

        def make(shared=shared):
            columns = _columns(Items(*shared.value), window)
            return lambda batch: columns(batch.column(batch.schema.get_field_index(text)))

        if out is None:
            out = add_columns(docs, ADDED, make)
            continue
        both = add_columns(out, ", ".join(f"_{field}" for field in ADDED.split(", ")), make)
        out = (
            both.withColumn("hits", merge_runs(F.concat("hits", "_hits")))
            .withColumn("item_ids", F.array_sort(F.array_union("item_ids", "_item_ids")))
            .withColumn("longest_match", F.greatest("longest_match", "_longest_match"))
            .drop("_n_words", "_hits", "_item_ids", "_longest_match")
        )
    return out


def merge_runs(runs: Column) -> Column:
    """Union of runs as sorted runs that do not touch."""
    end = lambda r: r["word"] + r["n_words"]

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["word"].alias("word"), (F.greatest(end(last), end(run)) - last["word"]).alias("n_words"))
        touches = (F.size(done) > 0) & (run["word"] <= end(F.try_element_at(done, F.lit(-1))))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(run))
        )

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<word:bigint,n_words:bigint>>"), add)


def n_hit(hits: Column) -> Column:
    """Words inside the runs."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, r: total + r["n_words"])


def contaminated(n_words: Column, hit: Column, share: int = HIT_SHARE) -> Column:
    return (hit > 0) & (hit * share >= n_words)


def judge(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """:func:`find_matches` with ``n_hit`` and ``contaminated``."""
    found = find_matches(docs, items, **names).withColumn("n_hit", n_hit(F.col("hits")))
    return found.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return judge(docs, items, **names).where(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])


def longest_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, item_word, n_words, doc_id, doc_word``: longest verbatim match of every benchmark suffix and its first location.

    Each shard reports its best location of a suffix; the best of all shards is an
    aggregation that combines before the shuffle. Suffixes without a match have no row.
    """
    schema = "item_id bigint, item_word bigint, n_words bigint, doc_id bigint, doc_word bigint"
    sc, found = docs.sparkSession.sparkContext, None
    for block in item_blocks(items, item_id, item_text):
        shared = sc.broadcast(astuple(block))  # plain arrays: executors need no copy of the class

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hasher = Items(*shared.value), Hasher()
            depth = int((items.end - np.arange(len(items.words))).max(initial=1))
            begins = np.searchsorted(items.item, items.item, "left")
            for batch in batches:
                for chunk in chunks(batch.column(1), word_table(NOT_ALNUM), lower_table(), SHARD_BYTES):
                    shard = Shard.of(chunk, hasher, depth)
                    window = np.zeros(len(items.words), np.int64)
                    longest, where, _, _ = search(shard.ids, shard.order, shard.query(items.words), items.end, window)
                    hit = np.flatnonzero(longest)
                    doc = shard.document(where[hit])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([items.ids[i] for i in items.item[hit]], pa.int64()),
                            pa.array(hit - begins[hit]),
                            pa.array(longest[hit]),
                            batch.column(0).take(pa.array(doc + chunk.first)).cast(pa.int64()),
                            pa.array(where[hit] - (shard.bounds[:-1] + np.arange(chunk.rows))[doc]),
                        ],
                        ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                    )

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"), best.alias("_at")).select(
        "item_id", "item_word", "n_words", "_at.doc_id", "_at.doc_word"
    )
