"""Byte-pair vocabularies trained and applied on DataFrames.

The corpus is read once, into a distributed table of distinct words and counts.
A word is a string with one character per symbol, so counting pairs is a regex
extraction. Training merges in rounds: see :func:`train`.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lingweave.functions.arrays import MASK_TOKEN, SPECIAL_TOKENS
from lingweave.functions.tokens import SYMBOL_BASE, byte_alphabet, byte_characters, piece_symbols, pretokenize, symbol, symbol_ids
from lingweave.operators.vocab import byte_vocab, word_freq
from lingweave.session import small_batches, spread, stored, temporary_tables

FIRST_BYTE = len(SPECIAL_TOKENS)
FIRST_MERGE = FIRST_BYTE + 256
LEADING_PAIRS = 128  # pairs of the first round
MOST_PAIRS = 1 << 16  # pairs of any round; this many rows come to the driver at most
SEGMENT_SYMBOLS = 1_000_000  # symbols in the distinct runs that the driver merges in a round
VECTOR_SYMBOLS = 64  # symbols up to which words are merged many at once
REMEMBERED_BYTES = 32 << 20  # pieces and ids that a task keeps


@dataclass(frozen=True)
class Merge:
    """One learnt pair as token ids; ``rank`` 0 is the first."""

    rank: int
    left: int
    right: int

    @property
    def merged(self) -> int:
        return FIRST_MERGE + self.rank

    @property
    def pair(self) -> str:
        return symbol(self.left) + symbol(self.right)


def piece_freq(df: DataFrame, text: Column) -> DataFrame:
    """Counts of byte-level pieces: ``word, freq``."""
    return word_freq(df, pretokenize(text))


def symbol_table(words: DataFrame) -> DataFrame:
    """``symbols, freq`` of a ``word, freq`` table, split into byte symbols; one-byte words hold no pair.

    The filter is on bytes: Catalyst moves it below the word count, where a filter
    on symbols would translate every token of the corpus.
    """
    pairable = words.where(F.octet_length("word") > 1)
    return pairable.select(piece_symbols(F.col("word"), FIRST_BYTE).alias("symbols"), "freq")


def pairs_of(symbols: Column) -> Column:
    """Adjacent symbol pairs of a word, overlapping."""
    return F.regexp_extract_all(symbols, F.lit("(?s)(?=(..))."), 1)


def pair_freqs(table: DataFrame) -> DataFrame:
    """``pair, freq`` of adjacent symbols, weighted by word counts."""
    pairs = table.select(F.explode(pairs_of(F.col("symbols"))).alias("pair"), "freq")
    return pairs.groupBy("pair").agg(F.sum("freq").alias("freq"))


def best_pairs(counts: DataFrame, n: int) -> list[tuple[str, int]]:
    """Top pairs by count, then by symbol ids; ``n`` rows come to the driver."""
    top = counts.orderBy(F.desc("freq"), F.asc("pair")).limit(n)
    return [(r["pair"], r["freq"]) for r in top.collect()]


def replay(symbols: Column, merges: Sequence[Merge], spark: SparkSession) -> Column:
    """Apply known merges, any number of them, in one pass: each word by its own best pairs."""
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(_ranks(merges))

    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = _rank_table(ranks.value)
        for batch in batches:
            ids, sizes = _symbols_of(batch)
            many = np.repeat(sizes > VECTOR_SYMBOLS, sizes)
            merged, after = merge_words(ids[~many], np.where(sizes > VECTOR_SYMBOLS, 0, sizes), keys, values)
            if many.any():
                words = np.split(merged, np.cumsum(after)[:-1])
                for i, word in zip(np.flatnonzero(sizes > VECTOR_SYMBOLS), np.split(ids[many], np.cumsum(sizes[sizes > VECTOR_SYMBOLS])[:-1])):
                    words[i] = np.array(_apply(word.tolist(), ranks.value), np.int64)
                merged, after = np.concatenate(words), np.array([len(w) for w in words])
            made = _strings_of(merged, after)
            yield made if not batch.null_count else pc.if_else(batch.is_valid(), made, None)

    return apply(symbols)


def _ranks(merges: Sequence[Merge]) -> dict[tuple[int, int], int]:
    """Rank of every pair; merges are bounded by the vocabulary, which the driver holds."""
    return {(m.left, m.right): m.rank for m in merges}


def _symbols_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and their number per word; a null word has none."""
    words = words.fill_null("")
    ids = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64) - SYMBOL_BASE
    return ids, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _strings_of(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of symbols; every symbol has four bytes."""
    data = (ids + SYMBOL_BASE).astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = np.append(0, np.cumsum(sizes) * 4).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _rank_table(ranks: Mapping[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs in order, and the rank of each."""
    keys = np.array([_pair_key(*pair) for pair in ranks] or [-1], np.int64)
    order = np.argsort(keys)
    return keys[order], np.array(list(ranks.values()) or [0], np.int64)[order]


def merge_words(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_apply` does, for many short words at once: every step merges the best pair of each word.

    A merge has a better rank than all pairs with its symbol, so no step brings a better pair than the one before.
    """
    none, word = np.iinfo(np.int64).max, np.repeat(np.arange(len(sizes)), sizes)
    done: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], word[:0])]
    while len(ids):
        pair = _pair_key(ids[:-1], ids[1:])
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.append(np.where((keys[at] == pair) & (word[:-1] == word[1:]), ranks[at], none), none)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
        left = best < none
        done.append((ids[~left], word[~left]))
        ids, word, rank, best = ids[left], word[left], rank[left], best[left]
        hits = np.flatnonzero(rank == best)
        # of overlapping pairs every second one counts, from the left
        first = np.append(True, np.diff(hits) != 1)[: len(hits)]
        run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        ids[hits] = FIRST_MERGE + rank[hits]
        kept = np.ones(len(ids), bool)
        kept[hits + 1] = False
        ids, word = ids[kept], word[kept]
    word = np.concatenate([w for _, w in done])
    order = np.argsort(word, kind="stable")
    return np.concatenate([i for i, _ in done])[order], np.bincount(word, minlength=len(sizes))


def linked_segments(symbols: Column, pairs: Sequence[str], spark: SparkSession) -> Column:
    """The longest runs of symbols of which every two neighbours are one of ``pairs``."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(np.sort(np.array([_pair_key(*symbol_ids(p)) for p in pairs], np.int64)))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids, sizes = _symbols_of(batch)
            ends = np.cumsum(sizes)
            pair = _pair_key(ids[:-1], ids[1:])
            linked = shared.value[np.minimum(np.searchsorted(shared.value, pair), len(shared.value) - 1)] == pair
            linked[ends[:-1] - 1] = False  # not from one word to the next
            edges = np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8))
            starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
            inside = (np.append(linked, False) | np.append(False, linked))[: len(ids)]
            offsets = np.searchsorted(starts, np.concatenate([[0], ends]))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _strings_of(ids[inside], stops - starts))

    return cut(symbols)


def _pair_key(left, right):
    return left * (1 << 32) + right


def segment_freqs(table: DataFrame, pairs: Sequence[str]) -> DataFrame:
    """``segment, freq`` of the distinct runs of linked symbols, weighted by word counts."""
    runs = table.select(F.explode(linked_segments(F.col("symbols"), pairs, table.sparkSession)).alias("segment"), "freq")
    return runs.groupBy("segment").agg(F.sum("freq").alias("freq"))


def greedy_merges(segments: Sequence[tuple[str, int]], first: int, most: int, limit: tuple[str, int]) -> list[tuple[int, int]]:
    """Merge the best pair of some segments again and again, while it ranks before ``limit``.

    ``limit`` is a pair and its count, new symbols are numbered from ``first``. Merging changes the
    segments that hold the pair only, found by an index from pairs to segments.
    """
    rows = [symbol_ids(text) for text, _ in segments]
    freqs = [freq for _, freq in segments]
    counts: dict[tuple[int, int], int] = defaultdict(int)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for row, freq, number in zip(rows, freqs, range(len(rows))):
        for pair in zip(row, row[1:]):
            counts[pair] += freq
            holders[pair].add(number)
    end = (-limit[1], tuple(symbol_ids(limit[0])))
    queue = [(-count, pair) for pair, count in counts.items()]
    heapify(queue)
    taken: list[tuple[int, int]] = []
    while queue and len(taken) < most:
        best = heappop(queue)
        pair = best[1]
        if counts[pair] != -best[0]:
            continue  # its count has changed since; the present one waits as well
        if best >= end:
            break
        merged = first + len(taken)
        taken.append(pair)
        touched = set()
        for number in holders.pop(pair):
            row, freq = rows[number], freqs[number]
            after = _merge_once(row, pair, merged)
            for sign, symbols in ((-freq, row), (freq, after)):
                for other in zip(symbols, symbols[1:]):
                    counts[other] += sign
                    touched.add(other)
            for other in zip(after, after[1:]):
                holders[other].add(number)
            rows[number] = after
        for other in touched:
            if counts[other] > 0:
                heappush(queue, (-counts[other], other))
    return taken


def _merge_once(row: Sequence[int], pair: tuple[int, int], merged: int) -> list[int]:
    """Replace a pair from left to right, without overlap."""
    after, at = [], 0
    while at < len(row):
        if row[at] == pair[0] and at + 1 < len(row) and row[at + 1] == pair[1]:
            after.append(merged)
            at += 2
        else:
            after.append(row[at])
            at += 1
    return after


def train(words: DataFrame, merges: int, min_frequency: int = 1, known: Sequence[Merge] = ()) -> list[Merge]:
    """Learn up to ``merges`` merges from ``word, freq``; exact greedy order.

    ``known`` merges are applied first, in one pass, and kept, so training continues from
    them. The tables of the rounds are deleted at the end; :class:`Training` keeps them.
    """
    with temporary_tables(words.sparkSession, "bpe") as folder:
        return _learn(_words_with(words, known, folder), known, merges, min_frequency, folder)[1]


def _words_with(words: DataFrame, known: Sequence[Merge], folder: str) -> DataFrame:
    """Stored ``symbols, freq`` of words that still hold a pair after the known merges."""
    table = spread(symbol_table(words), "symbols")
    if known:
        table = _replayed(table, known)
    return stored(table, "words", folder)


def _replayed(table: DataFrame, merges: Sequence[Merge]) -> DataFrame:
    done = table.select(replay(F.col("symbols"), merges, table.sparkSession).alias("symbols"), "freq")
    return done.where(F.char_length("symbols") > 1)


def _learn(table: DataFrame, known: Sequence[Merge], merges: int, min_frequency: int, folder: str) -> tuple[DataFrame, list[Merge]]:
    """Rounds of merges; the table after all of them, and the merges.

    A round counts all pairs and takes the leading ones. Counts only fall, and a pair with a new
    symbol counts at most as often as the pair that stood at its place; so until the first pair left
    out is due, merging happens only inside runs of symbols that leading pairs link. The distinct
    runs are few and short, since words are cut wherever a rarer pair stands: the driver merges them
    one by one, in exact order, and the words catch up in one pass. Runs are counted before they
    are fetched; more than ``SEGMENT_SYMBOLS`` of them halve the number of leading pairs.
    """
    learnt, size = list(known), LEADING_PAIRS
    while len(learnt) < merges:
        best = best_pairs(pair_freqs(table), size + 1)
        step, fits = _round(table, best[:size], best[size:], len(learnt), merges - len(learnt), min_frequency, folder)
        if not step:
            break
        learnt += step
        table = stored(_replayed(table, step), "words", folder)
        size = min(2 * size, MOST_PAIRS) if fits else max(1, size // 2)
    return table, learnt


def _round(
    table: DataFrame, leading: list[tuple[str, int]], rest: list[tuple[str, int]], done: int, most: int, min_frequency: int, folder: str
) -> tuple[list[Merge], bool]:
    """The merges of a round, and whether its runs left room for more pairs."""
    if not leading or leading[0][1] < min_frequency:
        return [], True
    halved = False
    while len(leading) > 1:
        runs = stored(segment_freqs(table, [p for p, _ in leading]), "runs", folder)
        size = runs.agg(F.coalesce(F.sum(F.char_length("segment")), F.lit(0)).alias("n")).first()["n"]
        if size <= SEGMENT_SYMBOLS:
            rows = runs.toArrow()
            first_out = rest[0] if rest and rest[0][1] >= min_frequency else (symbol(0) * 2, min_frequency - 1)
            found = greedy_merges(list(zip(rows["segment"].to_pylist(), rows["freq"].to_pylist())), FIRST_MERGE + done, most, first_out)
            return [Merge(done + i, *pair) for i, pair in enumerate(found)], not halved and 3 * size <= SEGMENT_SYMBOLS
        half = len(leading) // 2
        leading, rest, halved = leading[:half], leading[half:], True
    return [Merge(done, *symbol_ids(leading[0][0]))], False


class Training:
    """A vocabulary in training, stored as versions of merges and words.

    A version holds the merges and the words as they stand after them. Learning and adding text
    read the latest version and write the next; texts that were added are not read again. A version
    counts once its merges are there, which are written last, so a job that fails leaves the one before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def start(cls, words: DataFrame, path: str, known: Sequence[Merge] = ()) -> Training:
        """Begin with ``word, freq`` in a new folder."""
        training = cls(words.sparkSession, path)
        with temporary_tables(training.spark, "bpe") as folder:
            training._store(_words_with(words, known, folder), known)
        return training

    def version(self) -> int:
        """The latest complete version, -1 before the first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        whole = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version-*/merges/_SUCCESS")) or []
        return max((int(str(w.getPath()).split("/version-")[-1].split("/")[0]) for w in whole), default=-1)

    def merges(self) -> list[Merge]:
        return load_merges(self.spark, self._table("merges"))

    def words(self) -> DataFrame:
        """``symbols, freq`` of the words that still hold a pair."""
        return self.spark.read.schema("symbols string, freq long").parquet(self._table("words"))

    def learn(self, merges: int, min_frequency: int = 1) -> list[Merge]:
        """Go on to ``merges`` merges in all."""
        with temporary_tables(self.spark, "bpe") as folder:
            table, learnt = _learn(self.words(), self.merges(), merges, min_frequency, folder)
            self._store(table, learnt)
        return learnt

    def add(self, words: DataFrame) -> None:
        """Take in the ``word, freq`` of new text; earlier merges stay."""
        known = self.merges()
        with temporary_tables(self.spark, "bpe") as folder:
            both = self.words().unionByName(_words_with(words, known, folder))
            self._store(both.groupBy("symbols").agg(F.sum("freq").alias("freq")), known)

    def _table(self, name: str) -> str:
        return f"{self.path}/version-{self.version():06d}/{name}"

    def _store(self, words: DataFrame, merges: Sequence[Merge]) -> None:
        number = self.version() + 1
        words.write.mode("overwrite").parquet(f"{self.path}/version-{number:06d}/words")
        save_merges(merges, self.spark, f"{self.path}/version-{number:06d}/merges")


def merges_of_tokens(tokens: Sequence[bytes]) -> list[Merge]:
    """The merges of a ranked vocabulary of byte strings, single bytes first.

    A token is made by the last merge that the tokens before it leave to do: with all of
    their merges applied to its bytes, exactly two parts remain.
    """
    if sorted(tokens[:256]) != [bytes([b]) for b in range(256)]:
        raise ValueError("a byte-level vocabulary begins with the 256 bytes")
    alphabet = byte_alphabet(FIRST_BYTE)
    byte_ids = [alphabet[ch] for ch in byte_characters()]
    ranks: dict[tuple[int, int], int] = {}
    merges: list[Merge] = []
    for token in tokens[256:]:
        parts = _apply([byte_ids[b] for b in token], ranks)
        if len(parts) != 2:
            raise ValueError(f"token {token!r} is no merge of two tokens before it")
        merges.append(Merge(len(merges), *parts))
        ranks[parts[0], parts[1]] = merges[-1].rank
    return merges


def token_texts(merges: Sequence[Merge]) -> list[str]:
    """Byte-level text of every merge, in rank order."""
    texts = sorted(byte_characters())
    for m in merges:
        texts.append(texts[m.left - FIRST_BYTE] + texts[m.right - FIRST_BYTE])
    return texts[256:]


def merge_table(merges: Sequence[Merge], spark: SparkSession) -> DataFrame:
    """``rank, left, right, merged`` as byte-level text."""
    texts = sorted(byte_characters()) + token_texts(merges)
    rows = [
        (m.rank, texts[m.left - FIRST_BYTE], texts[m.right - FIRST_BYTE], texts[m.merged - FIRST_BYTE])
        for m in merges
    ]
    return spark.createDataFrame(rows, "rank int, left string, right string, merged string")


def save_merges(merges: Sequence[Merge], spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    rows = [(m.rank, m.left, m.right) for m in merges]
    spark.createDataFrame(rows, "rank int, left int, right int").coalesce(1).write.mode(mode).parquet(path)


def load_merges(spark: SparkSession, path: str) -> list[Merge]:
    return [Merge(*r) for r in spark.read.parquet(path).orderBy("rank").collect()]


def _apply(word: Sequence[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Merge the best-ranked pair of a word, leftmost first, until none is left.

    Candidates wait in a heap, so a very long word costs n log n.
    """
    ids: list[int | None] = list(word)
    size = len(ids)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(ranks[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if ids[i] is None or j >= size or ranks.get((ids[i], ids[j])) != rank:
            continue  # one of the two has been merged since
        ids[i], ids[j] = FIRST_MERGE + rank, None
        after[i] = after[j]
        if after[i] < size:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < size and (ids[left], ids[right]) in ranks:
                heappush(heap, (ranks[ids[left], ids[right]], left))
    return [x for x in ids if x is not None]


def bpe_ids(text: Column, merges: Sequence[Merge], spark: SparkSession) -> Column:
    """Token ids of a text as ``array<int>``; splitting runs in the JVM."""
    return piece_ids(pretokenize(text), merges, spark)


def piece_ids(pieces: Column, merges: Sequence[Merge], spark: SparkSession, whole: Mapping[str, int] = {}) -> Column:
    """Token ids of an array of pieces, one after another; pieces named in ``whole`` are one token each.

    Tasks get the merges (at most one vocabulary), merge each distinct piece of a batch once and
    remember it, and put texts together by place.
    """
    small_batches(spark)
    ranks = spark.sparkContext.broadcast((_ranks(merges), dict(whole)))
    alphabet = byte_alphabet(FIRST_BYTE)
    byte_ids = [alphabet[ch] for ch in byte_characters()]

    @F.arrow_udf("array<int>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, bytes] = {}
        held = 0
        pairs, single = ranks.value
        for batch in batches:
            found = batch.flatten().dictionary_encode()
            known = []
            for piece in found.dictionary.to_pylist():
                ids = seen.get(piece)
                if ids is None:
                    if held > REMEMBERED_BYTES:
                        seen.clear()
                        held = 0
                    ids = seen[piece] = array("i", [single[piece]] if piece in single else _apply([byte_ids[b] for b in piece.encode()], pairs)).tobytes()
                    held += getsizeof(piece) + getsizeof(ids) + 100  # its place in the table
                known.append(ids)
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat = np.frombuffer(b"".join(known), np.int32)
            place = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own = size[place]
            ends = np.cumsum(own)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - own - (np.cumsum(size) - size)[place], own)
            per_text = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)))
            offsets = np.append(0, ends)[per_text]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[at], pa.int32()))

    return split(pieces)


class BpeTokenizer:
    """Encodes and decodes with trained merges: specials, bytes, merges, then the mask token."""

    def __init__(self, merges: Sequence[Merge], spark: SparkSession):
        self.merges, self.spark = list(merges), spark
        self.mask_id = FIRST_MERGE + len(self.merges)

    def special_ids(self) -> list[int]:
        return [*range(FIRST_BYTE), self.mask_id]

    def id_of(self, token: str) -> int:
        return self.mask_id if token == MASK_TOKEN else SPECIAL_TOKENS.index(token)

    def encoded(self, df: DataFrame, text: str, out: str, most: int | None = None) -> DataFrame:
        """Add the (first ``most``) token ids of a text; a null text has none."""
        ids = self.ids(F.col(text))
        return df.withColumn(out, ids if most is None else F.slice(ids, 1, most))

    def decoded(self, df: DataFrame, ids: str, out: str) -> DataFrame:
        """Add the text of ids; special and unknown ids have none, cut characters become U+FFFD."""
        value = {ch: b for b, ch in enumerate(byte_characters())}
        texts = sorted(byte_characters()) + token_texts(self.merges)
        tokens = [bytes(value[c] for c in t) for t in texts] + self._more()
        small_batches(self.spark)
        shared = self.spark.sparkContext.broadcast(tokens)

        @F.arrow_udf("string")
        def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = pa.array(shared.value, pa.large_binary())
            sizes = np.fromiter(map(len, shared.value), np.int64, len(table))
            for batch in batches:
                at = batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) - FIRST_BYTE
                known = (at >= 0) & (at < len(table))
                data = memoryview(table.take(pa.array(at[known])).buffers()[2] or b"")
                ends = np.append(0, np.cumsum(np.where(known, sizes[np.where(known, at, 0)], 0)))
                per_text = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)))
                places = ends[per_text].tolist()
                texts = (str(data[a:b], "utf-8", "replace") for a, b in zip(places, places[1:]))
                yield pa.array([text if there else None for text, there in zip(texts, batch.is_valid().to_pylist())], pa.string())

        return df.withColumn(out, join(F.col(ids)))

    def _more(self) -> list[bytes]:
        """Bytes of the mask and of the tokens after it; the mask has none."""
        return [b""]

    def ids(self, text: Column) -> Column:
        """Token ids of a text; a null text has none."""
        return bpe_ids(F.coalesce(text, F.lit("")), self.merges, self.spark)

    def count(self, text: Column) -> Column:
        """Number of tokens of a text, for :func:`lingweave.operators.vocab.token_totals`."""
        return F.size(self.ids(text))

    def vocabulary(self) -> DataFrame:
        """``id, token`` of all tokens."""
        return byte_vocab(token_texts(self.merges), self.spark)


def save_vocabulary(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store ``id, token``, sorted, as one file: a vocabulary is small."""
    vocab.coalesce(1).sortWithinPartitions("id").write.mode(mode).parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, token string").parquet(path)
