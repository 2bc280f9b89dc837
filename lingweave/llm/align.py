"""Alignment of two tokenizers over the same text, and how often their tokens meet in the corpus.

Texts are encoded twice with a blank in front: by byte-level byte pairs (A) and by pieces (B). Byte offsets where tokens
of both end cut them into groups. In the arrays of token ends a one-to-one stretch is a diagonal: at the current shift
between the two indexes, runs of 1, 2, 4, ... ends are compared, the last one halved down to the exact place where the
run breaks; there the group is resolved by stepping the side that is behind until both ends meet, which sets the new shift.

A text is a sequence of *units*, cut before a blank that follows a character that is certainly no white space. No token of
either vocabulary goes on over such a place (checked when they are loaded), so a unit's tokens and groups do not depend on
what is around it. Every
distinct unit of a batch (``BATCH_BYTES`` of text) is encoded and aligned once, all of them as one pair of end arrays.

A link is a pair of overlapping tokens; a link's count is how many links of the corpus join the same two ids. A batch emits
each of its id pairs once with its number of links, so a pair with a third of all links is one row per batch. Counts are
summed, the highest count of every B id (as many rows as B has tokens) is sent along, and the answers meet their batch in
one shuffle. Batches are stored before, each as one row, so nothing is encoded twice and a lost executor repeats a batch.

Cases: a null or empty text, and one whose tokens do not spell a blank and the text (such as a literal U+2581), has no
tokens, zeros and an empty digest, and counts nowhere; strings of special tokens are ordinary text; repeated rows and ids
count one by one; texts of any length are encoded whole; an empty table gives no rows; input columns named like an output
are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lingweave.functions.tokens import byte_characters
from lingweave.llm.exchange import packed, unpacked
from lingweave.llm.text import map_arrow, sums_by_text, text_blocks
from lingweave.llm.tokens import PATTERN
from lingweave.session import stored

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = 8 << 20

OWN = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
ADDED = f"{OWN}, n_best bigint, count_sum bigint"
PARTS = "batch bigint, record binary, at int, a int, b int, n bigint"
MARK = "▁"


class Spelling:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: Sequence[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._data = np.frombuffer(b"".join(tokens), np.uint8)
        borders = np.concatenate([[0], np.cumsum(self.sizes)])
        if not np.isin(unit_starts(self._data, borders), borders).all():
            raise ValueError("a token goes on over a blank where units are cut")
        self._first = borders[:-1]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, one after another."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self._data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - self._first[ids], sizes)]


class BytePairs:
    """Side A: a byte-level vocabulary of the tokenizers library, whose ids are in merge order."""

    def __init__(self, stored: bytes):
        import tiktoken

        value = {ch: b for b, ch in enumerate(byte_characters())}
        spelt = {bytes(value[c] for c in token): i for token, i in json.loads(stored)["model"]["vocab"].items()}
        tokens = [b""] * (max(spelt.values()) + 1)
        for token, i in spelt.items():
            tokens[i] = token
        self.spelling = Spelling(tokens)
        self._encoder = tiktoken.Encoding("stored", pat_str=PATTERN, mergeable_ranks=spelt, special_tokens={})

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        return [self._encoder.encode_ordinary(u) for u in units]


class Pieces:
    """Side B: a piece vocabulary, which puts the blank in front itself."""

    def __init__(self, stored: bytes):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_proto=stored)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.spelling = Spelling([bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)])
        # the model gives no piece for an empty text, so a lone blank is read off a longer one
        self._blank = m.encode("x ")[len(m.encode("x")) :]

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        return [ids if u != " " else self._blank for u, ids in zip(units, self._model.encode([u[1:] for u in units], num_threads=1))]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at every text, and at blanks after a character that is certainly no white space.

    Sure are visible ASCII characters and those of two bytes from U+00C0 on.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[at >= 2]
    before, earlier = data[at - 1], data[at - 2]
    sure = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0) & (earlier >= 0xC3) & (earlier < 0xE0))
    return np.union1d(offsets[:-1][np.diff(offsets) > 0], at[sure])


def diagonal_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and of B tokens up to the end of every group; ``a`` and ``b`` are token ends, the last ones equal."""
    x, y = a.tolist(), b.tolist()
    i = j = 0
    end = len(x)
    runs, odd = [], []
    while i < end:
        first, step = i, 1
        while i < end and x[i : i + step] == y[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        if i > end:  # the last probe went over both ends
            j, i = j - (i - end), end
        while step > 1 and i < end:
            step //= 2
            if x[i : i + step] == y[j : j + step]:
                i, j = min(i + step, end), j + step
        if i > first:
            runs.append((first, min(j, len(y)) - (i - first), i - first))
        if i < end:
            u, v = x[i], y[j]
            while u != v:
                if u < v:
                    i += 1
                    u = x[i]
                else:
                    j += 1
                    v = y[j]
            i, j = i + 1, j + 1
            odd.append((i, j))
    starts_a, starts_b, sizes = np.array(runs, np.int64).reshape(-1, 3).T
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    ends = np.array(odd, np.int64).reshape(-1, 2).T
    return (
        np.sort(np.concatenate([np.repeat(starts_a, sizes) + place, ends[0]])),
        np.sort(np.concatenate([np.repeat(starts_b, sizes) + place, ends[1]])),
    )


class Units:
    """Distinct units of a batch: their tokens on both sides, groups and links."""

    def __init__(self, units: pa.Array, left: BytePairs, right: Pieces):
        data, offsets = np.frombuffer(units.buffers()[2] or b"", np.uint8), np.frombuffer(units.buffers()[1], np.int64)[: len(units) + 1]
        texts = units.to_pylist()
        sides = [[np.fromiter((i for ids in e for i in ids), np.int64), np.fromiter(map(len, e), np.int64, len(e))] for e in (left.encode(texts), right.encode(texts))]
        spellings = (left.spelling, right.spelling)
        self.spelt = np.ones(len(units), bool)
        for (ids, sizes), spelling in zip(sides, spellings):
            self.spelt &= sums_by_text(spelling.sizes[ids], np.concatenate([[0], np.cumsum(sizes)])) == np.diff(offsets)
        self._keep(sides)
        own = data[: offsets[-1]][np.repeat(self.spelt, np.diff(offsets))]
        of_byte = np.repeat(np.arange(len(units)), np.where(self.spelt, np.diff(offsets), 0))
        wrong = np.zeros(len(units), bool)
        for (ids, _), spelling in zip(sides, spellings):
            wrong[of_byte[spelling.bytes_of(ids) != own]] = True
        self.spelt &= ~wrong
        self._keep(sides)
        (self.a, self.n_a), (self.b, self.n_b) = sides
        ends_a, ends_b = (np.cumsum(s.sizes[ids]) for (ids, _), s in zip(sides, spellings))
        self.last_a, self.last_b = diagonal_groups(ends_a, ends_b)
        unit_of_a = np.repeat(np.arange(len(units)), self.n_a)
        self.n_groups = np.bincount(unit_of_a[self.last_a - 1], minlength=len(units))
        # tokens overlap once between any two neighbouring ends of either side
        ends = np.union1d(ends_a, ends_b)
        at = np.searchsorted(ends_a, ends)
        self.link_a, self.link_b = self.a[at], self.b[np.searchsorted(ends_b, ends)]
        self.n_links = np.bincount(unit_of_a[at], minlength=len(units))

    def _keep(self, sides: list[list[np.ndarray]]) -> None:
        """Take the tokens away from units that are not spelt."""
        for side in sides:
            side[0] = side[0][np.repeat(self.spelt, side[1])]
            side[1] = np.where(self.spelt, side[1], 0)

    def shown(self) -> list[bytes]:
        """The groups of every unit, A and B ids in order."""
        first_a, first_b = np.concatenate([[0], self.last_a])[:-1], np.concatenate([[0], self.last_b])[:-1]
        group_a = np.repeat(np.arange(len(self.last_a)), self.last_a - first_a)
        group_b = np.repeat(np.arange(len(self.last_b)), self.last_b - first_b)
        total = len(self.a) + len(self.b)
        ids, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + first_b[group_a]] = self.a
        ids[np.arange(len(self.b)) + self.last_a[group_b]] = self.b
        sign[first_a + first_b] = ord(";")
        sign[self.last_a + first_b] = ord("|")
        signs = pa.StringArray.from_buffers(total, pa.py_buffer(np.arange(total + 1, dtype=np.int32)), pa.py_buffer(sign.tobytes()))
        text = pc.binary_join_element_wise(signs, pa.array(ids).cast(pa.string()), "")
        raw = text.buffers()[2].to_pybytes() if total else b""
        at = np.frombuffer(text.buffers()[1], np.int32) if total else np.zeros(1, np.int32)
        ends = at[np.cumsum(self.n_a + self.n_b)].tolist()
        return [raw[s + 1 : e] for s, e in zip([0, *ends], ends)]


def encode_batches(docs: DataFrame, text: str, left: str, right: str, shown: bool, batch_bytes: int) -> DataFrame:
    """``batch, record`` of every batch and ``batch, at, a, b, n`` of its id pairs."""
    spark = docs.sparkSession
    with open(left, "rb") as a, open(right, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    parts = StructType.fromDDL(PARTS)
    names = parts.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = None, TaskContext.get().partitionId() << 32
        for rows in batches:
            sides = sides or (BytePairs(shared.value[0]), Pieces(shared.value[1]))
            column = rows.column(rows.schema.get_field_index(text)).fill_null("")
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
            for first, data, offsets in text_blocks(column, batch_bytes):
                part = rows.slice(first, len(offsets) - 1)
                record, pairs = encode_batch(part.drop_columns([text]), data, offsets, *sides, shown)
                size, same = len(pairs[0]), pa.array([number], pa.int64())
                yield pa.RecordBatch.from_arrays([same, pa.array([record], pa.binary()), *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]], names)
                yield pa.RecordBatch.from_arrays(
                    [same.take(pa.array(np.zeros(size, np.int64))), pa.nulls(size, pa.binary()), pa.array(np.arange(size), pa.int32()), *[pa.array(p, t) for p, t in zip(pairs, (pa.int32(), pa.int32(), pa.int64()))]],
                    names,
                )
                number += 1
                # what the batch took is given back, so that workers stay small between batches
                del record, pairs
                pa.default_memory_pool().release_unused()

    return map_arrow(docs, run, parts)


def encode_batch(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, left: BytePairs, right: Pieces, shown: bool) -> tuple[bytes, list[np.ndarray]]:
    """A batch as one packed value, and its id pairs: A ids, B ids and numbers of links."""
    starts = unit_starts(data, offsets)
    borders = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(borders), pa.py_buffer(data.tobytes())).dictionary_encode()
    place = words.indices.to_numpy()
    units = Units(words.dictionary, left, right)
    bounds = np.searchsorted(starts, offsets)
    good = sums_by_text((~units.spelt[place]).astype(np.int64), bounds) == 0
    texts = np.repeat(np.arange(len(good)), np.diff(bounds))
    place = place[good[texts]]
    sizes = np.where(good, np.diff(bounds), 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    known = units.shown()
    groups = [b";".join([known[p] for p in place[s:e].tolist()]) for s, e in zip(bounds, bounds[1:])]
    times = np.bincount(place, minlength=len(known))
    keys, link_pair = np.unique(units.link_a << 32 | units.link_b, return_inverse=True)
    counts = np.bincount(link_pair, np.repeat(times, units.n_links), len(keys)).astype(np.int64)
    total = lambda values: pa.array(sums_by_text(values[place], bounds))
    lists = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
    made = {
        **dict(zip(rows.schema.names, rows.columns)),
        "n_a": total(units.n_a),
        "n_b": total(units.n_b),
        "n_groups": total(units.n_groups),
        "n_links": total(units.n_links),
        "groups_sha256": pa.array([sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
        **({"groups": pa.array(groups, pa.binary()).cast(pa.string())} if shown else {}),
        "_units": lists(place, sizes),
    }
    links = pa.table({"links": lists(link_pair, units.n_links)})
    record = pa.table({"docs": pa.array([packed(pa.table(made))], pa.binary()), "links": pa.array([packed(links)], pa.binary())})
    return packed(record), [keys >> 32, keys & 0xFFFFFFFF, counts]


def align(
    docs: DataFrame, text: str = "text", left: str = VOCABULARY_A, right: str = VOCABULARY_B, groups: bool = False, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The documents without their texts and with ``ADDED``; ``groups`` adds the groups as text too."""
    added = [f.name for f in StructType.fromDDL(ADDED).fields] + ["groups"]
    kept = [c for c in docs.columns if c == text or c not in added]
    parts = stored(encode_batches(docs.select(*[f"`{c}`" for c in kept]), text, left, right, groups, batch_bytes), "aligned")
    pairs = parts.where("at is not null")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    # one row per id of B at most
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    judged = counts.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = pairs.select("batch", "at", "a", "b").join(judged, ["a", "b"]).select("batch", "at", "n", "best")
    own = [f for f in docs.schema.fields if f.name in kept and f.name != text]
    shown = StructType.fromDDL("groups string").fields if groups else []
    schema = StructType([*[StructField(f.name, f.dataType) for f in own], *StructType.fromDDL(OWN).fields, *shown, *StructType.fromDDL("n_best bigint, count_sum bigint").fields])

    def run(records: pa.Table, found: pa.Table) -> pa.Table:
        made = []
        for record in records["record"]:
            whole = unpacked(record)
            rows, links = unpacked(whole["docs"][0]), unpacked(whole["links"][0])["links"].combine_chunks()
            at = found["at"].to_numpy()
            counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            counts[at], best[at] = found["n"].to_numpy(), found["best"].to_numpy()
            bounds, flat = links.offsets.to_numpy(), links.values.to_numpy()
            units = rows["_units"].combine_chunks()
            docs_at, place = units.offsets.to_numpy(), units.values.to_numpy()
            sums = [pa.array(sums_by_text(sums_by_text(v[flat], bounds)[place], docs_at)) for v in (best, counts)]
            rows = rows.drop_columns(["_units"])
            made.append(pa.table([*rows.columns, *sums], schema.names))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(made) if made else to_arrow_schema(schema).empty_table()

    records = parts.where("record is not null").select(F.col("batch").alias("_batch"), "record")
    return records.groupBy("_batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
