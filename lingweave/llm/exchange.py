"""Ask a corpus-wide question about words once per batch of documents, not once per token.

Documents are worked on in batches of some megabytes. A batch sends each of its distinct
words once, to the task that owns the word's hash range; that task sends one answer per word
back to the batch. A word that fills a third of the corpus is one entry per batch, and all
hash ranges are equally full. The documents meet their answers in one shuffle by batch.

The input is read twice and must come in the same batches both times, as a stored table
does; a batch whose answers do not fit its words stops the job.

Where most words are rare, ``words_by_span``, ``store_answers`` and ``answered_in_place`` ask for the distinct words of
all batches of some 32 MB together and leave the documents where they are: the answers of
a span become one file in the shared folder, and the task that reads the span's documents again opens it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lingweave.llm.text import WHITE, Chunk, Hasher, chunks, distinct, input_bytes, lower_table, map_arrow, text_blocks, word_table

BATCH_BYTES = 2 << 20
ARROW_ROWS = "2000"  # rows that Spark hands to Python at once; its own default suits short values
SPAN_BYTES = 32 << 20  # of text whose distinct words are asked for together
OWNER_BYTES = 16 << 20  # input per hash range


def owners(df: DataFrame) -> int:
    """Number of hash ranges: in proportion to the input, so that a range fits a task.

    Also makes the session's Arrow batches smaller, since rows hold whole texts. Rows that did not come from files have no size; the session's partitions stand in.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= int(ARROW_ROWS):
        conf.set(key, ARROW_ROWS)
    size = input_bytes(df)
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size is None else size // OWNER_BYTES)


def packed(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as one compressed value; rows of words shrink to a quarter of Spark's own form."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


def batch_key(chunk: Chunk, number: int) -> int:
    """Names a batch by its place and contents, so a batch that changed finds no answer."""
    place = f"{TaskContext.get().partitionId()}:{number}:{chunk.rows}:".encode()
    digest = hashlib.blake2b(place + chunk.offsets.tobytes(), digest_size=8)
    digest.update(chunk.data)
    return int.from_bytes(digest.digest(), "little", signed=True)


def distinct_words(chunk: Chunk, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, first word number of each, and the place of every word's hash."""
    return distinct(hasher.spans(chunk.data, chunk.starts, chunk.ends))


def strings(chunk: Chunk, which: np.ndarray) -> pa.Array:
    """Some words of a chunk as an Arrow column."""
    starts, sizes = chunk.starts[which], (chunk.ends - chunk.starts)[which]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chunk.data[at].tobytes()))


def text_of(column: pa.Array, blank: bool) -> pa.Array:
    """The texts; ``blank`` puts one in front of those that are not empty."""
    if not blank:
        return column
    column = column.fill_null("")
    return pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(" ", column, ""))


def batches_of(rows: pa.RecordBatch, text: str, table: np.ndarray, lower: np.ndarray | None, blank: bool, most: int) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Some whole texts at a time, as rows and as a chunk."""
    column = rows.column(rows.schema.get_field_index(text))
    for first, _, offsets in text_blocks(column, most):
        part = rows.slice(first, len(offsets) - 1)
        yield part, next(chunks(text_of(column.slice(first, len(offsets) - 1), blank), table, lower, 1 << 40))


def tagged(df: DataFrame, text: str, lower: bool, outside: Sequence[int] = WHITE, blank: bool = False) -> DataFrame:
    """``_batch, _docs``: every batch of documents as one compressed Arrow table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low, number = word_table(outside), lower_table() if lower else None, 0
        for batch in batches:
            for part, chunk in batches_of(batch, text, table, low, blank, BATCH_BYTES):
                docs = packed(part)
                key = batch_key(chunk, number)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([docs], pa.binary())], ["_batch", "_docs"])

    return map_arrow(df, run, StructType.fromDDL("_batch bigint, _docs binary"))


def words_by_owner(
    df: DataFrame,
    text: str,
    lower: bool,
    count: int,
    learn: str | None = None,
    outside: Sequence[int] = WHITE,
    adjust: Callable[[Chunk], Chunk] = lambda c: c,
    blank: bool = False,
) -> DataFrame:
    """``owner, batch, asked``: the distinct words of every batch and range, packed, with ``times``.

    ``times`` counts the words of rows whose ``learn`` column is true. ``outside`` are the
    bytes that separate words; ``adjust`` may move the borders of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low, number, hasher = word_table(outside), lower_table() if lower else None, 0, Hasher()
        for batch in batches:
            for part, chunk in batches_of(batch, text, table, low, blank, BATCH_BYTES):
                key = batch_key(chunk, number)
                number += 1
                chunk = adjust(chunk)
                hashes, first, place = distinct_words(chunk, hasher)
                if learn:
                    own = part.column(part.schema.get_field_index(learn))
                    weights = own.to_numpy(zero_copy_only=False).astype(np.float64)[chunk.text]
                else:
                    weights = np.ones(len(place))
                times = np.bincount(place, weights, len(hashes)).astype(np.int64)
                owner = ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(owner, np.arange(count + 1))
                full = np.flatnonzero(np.diff(cuts))
                whole = pa.table({"words": strings(chunk, first), "times": times})
                asked = [packed(whole.slice(cuts[o], cuts[o + 1] - cuts[o])) for o in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), key), pa.int64()), pa.array(asked, pa.binary())],
                    ["owner", "batch", "asked"],
                )

    return map_arrow(df, run, StructType.fromDDL("owner bigint, batch bigint, asked binary"))


OWNED = "owner bigint, batch bigint, words array<string>, times array<bigint>, place binary"


def owned(sent: DataFrame) -> DataFrame:
    """Per hash range: one row without batch holds all distinct words and their ``times``; the
    others hold, packed, the place of every word that a batch asked for."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table["asked"]]
        flat = pa.concat_arrays([p["words"].combine_chunks() for p in parts])
        asked = np.concatenate([p["times"].to_numpy() for p in parts])
        hashes, first, place = distinct(hash_strings(flat, Hasher()))
        times = np.bincount(place, asked, len(hashes)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        packs = [packed(pa.table({"place": place[e - len(p) : e].astype(np.int32)})) for p, e in zip(parts, ends)]
        one = lambda values: pa.array([values], pa.list_(values.type))
        n, owner = table.num_rows, table["owner"][0].as_py()
        return pa.table(
            {
                "owner": pa.array([owner] * (n + 1), pa.int64()),
                "batch": pa.concat_arrays([pa.nulls(1, pa.int64()), table["batch"].combine_chunks()]),
                "words": pa.concat_arrays([one(flat.take(pa.array(first))), pa.nulls(n, pa.list_(pa.string()))]),
                "times": pa.concat_arrays([one(pa.array(times)), pa.nulls(n, pa.list_(pa.int64()))]),
                "place": pa.array([None, *packs], pa.binary()),
            }
        )

    return sent.groupBy("owner").applyInArrow(run, OWNED)


def answer_rows(table: pa.Table, answers: pa.Table) -> pa.Table:
    """``batch, owner, answer`` for the batches of a range, from one answer per distinct word."""
    asked = table.filter(pc.is_valid(table["batch"])).combine_chunks()
    packs = [packed(answers.take(unpacked(p)["place"])) for p in asked["place"]]
    return pa.table({"batch": asked["batch"], "owner": asked["owner"].cast(pa.int64()), "answer": pa.array(packs, pa.binary())})


ANSWER = "batch bigint, owner bigint, answer binary"


def hash_strings(words: pa.Array, hasher: Hasher) -> np.ndarray:
    """Hashes of an Arrow column of words, equal to those of the same words in texts."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    return hasher.spans(data, offsets[:-1], offsets[1:])


def answered(
    df: DataFrame,
    text: str,
    lower: bool,
    answers: DataFrame,
    ddl: str,
    make: Callable[[], Callable],
    drop: tuple[str, ...] = (),
    outside: Sequence[int] = WHITE,
    adjust: Callable[[Chunk], Chunk] = lambda c: c,
    blank: bool = False,
) -> DataFrame:
    """Documents with columns computed from the answers to their words.

    ``answers`` are rows of :func:`answer_rows`. ``make()(chunk, place, answers, rows)`` gets
    the words of a batch, the place of each word's answer, the table of answers, and the
    documents; it returns the new columns.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept], *StructType.fromDDL(ddl).fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns, hasher = make(), Hasher()
        parts = [unpacked(x) for x in right.sort_by("owner")["answer"]]
        answers = pa.concat_tables(parts).combine_chunks() if parts else None
        made = []
        for docs in left["_docs"]:
            rows = unpacked(docs)
            texts = text_of(rows[text].combine_chunks(), blank)
            for chunk in chunks(texts, word_table(outside), lower_table() if lower else None, 1 << 40):
                chunk = adjust(chunk)
                hashes, _, place = distinct_words(chunk, hasher)
                if (len(answers) if answers else 0) != len(hashes):
                    raise ValueError(f"answers do not fit the {len(hashes)} words of a batch: the input changed between two reads; store it first")
                made.append(pa.table([*[rows[f.name] for f in kept], *columns(chunk, place, answers, rows)], schema.names))
        # what the batch took is given back, so that workers stay small between batches
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(made) if made else to_arrow_schema(schema).empty_table()

    both = tagged(df, text, lower, outside, blank).groupBy("_batch").cogroup(answers.withColumnRenamed("batch", "_batch").groupBy("_batch"))
    return both.applyInArrow(run, schema)


class Span:
    """Neighbouring batches of a task: distinct words in order of their hash, and a name by place and contents."""

    def __init__(self, number: int):
        self.digest = hashlib.blake2b(f"{TaskContext.get().partitionId()}:{number}".encode(), digest_size=8)
        self.hashes, self.words, self.size = np.zeros(0, np.uint64), [], 0
        self.batches: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def add(self, part: pa.RecordBatch, chunk: Chunk, adjust: Callable[[Chunk], Chunk], hasher: Hasher, keep: bool) -> None:
        self.digest.update(chunk.offsets.tobytes())
        self.digest.update(chunk.data)
        self.size += len(chunk.data)
        chunk = adjust(chunk)
        hashes, first, place = distinct_words(chunk, hasher)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if keep:
            self.batches.append((part, hashes, place.astype(np.int32)))
        else:
            self.words.append((hashes[new], strings(chunk, first[new])))
        self.hashes = np.sort(np.concatenate([self.hashes, hashes[new]]), kind="stable")

    @property
    def key(self) -> int:
        return int.from_bytes(self.digest.digest(), "little", signed=True)

    def sorted_words(self) -> pa.Array:
        order = np.argsort(np.concatenate([h for h, _ in self.words]))
        return pa.concat_arrays([w for _, w in self.words]).take(pa.array(order))


def spans(
    batches: Iterator[pa.RecordBatch], text: str, outside: Sequence[int], adjust: Callable[[Chunk], Chunk], blank: bool, keep: bool = False
) -> Iterator[Span]:
    """The spans of a task; ``keep`` holds their rows and the places of words, but no borders, which take more than the texts."""
    table, hasher, number = word_table(outside), Hasher(), 0
    most = max(1, BATCH_BYTES // 2)  # words are asked for by span, so smaller batches cost no shuffle
    span = Span(number)
    for batch in batches:
        for part, chunk in batches_of(batch, text, table, None, blank, most):
            span.add(part, chunk, adjust, hasher, keep)
            if span.size >= SPAN_BYTES:
                yield span
                number += 1
                span = Span(number)
    yield span


def words_by_span(df: DataFrame, text: str, count: int, outside: Sequence[int] = WHITE, adjust: Callable[[Chunk], Chunk] = lambda c: c, blank: bool = False) -> DataFrame:
    """``owner, batch, asked`` as :func:`words_by_owner` gives them, for spans of batches; ``times`` counts spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in spans(batches, text, outside, adjust, blank):
            if not len(span.hashes):
                continue
            owner = ((span.hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(owner, np.arange(count + 1))
            full = np.flatnonzero(np.diff(cuts))
            whole = pa.table({"words": span.sorted_words(), "times": np.ones(len(owner), np.int64)})
            asked = [packed(whole.slice(cuts[o], cuts[o + 1] - cuts[o])) for o in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array(np.full(len(full), span.key), pa.int64()), pa.array(asked, pa.binary())], ["owner", "batch", "asked"]
            )

    return map_arrow(df, run, StructType.fromDDL("owner bigint, batch bigint, asked binary"))


def _answer_path(base: str, key: int) -> str:
    return f"{base}/span-{key & (1 << 64) - 1:016x}"


def store_answers(answers: DataFrame, folder: str) -> None:
    """One file for every span of ``answers``, which are rows of :func:`answer_rows`.

    A file takes its name when it is whole, so a task that runs again leaves the same files.
    """

    def run(table: pa.Table) -> pa.Table:
        files, base = fs.FileSystem.from_uri(folder)
        path = _answer_path(base, table["batch"][0].as_py())
        data = packed(pa.concat_tables([unpacked(x) for x in table.sort_by("owner")["answer"]]).combine_chunks())
        draft = f"{path}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(draft) as out:
            out.write(data)
        files.move(draft, path)
        return pa.table({"bytes": pa.array([len(data)], pa.int64())})

    answers.groupBy("batch").applyInArrow(run, "bytes bigint").agg({"bytes": "sum"}).collect()


def answered_in_place(
    df: DataFrame,
    text: str,
    folder: str,
    ddl: str,
    make: Callable[[], Callable],
    outside: Sequence[int] = WHITE,
    adjust: Callable[[Chunk], Chunk] = lambda c: c,
    blank: bool = False,
) -> DataFrame:
    """Documents with columns computed from the stored answers of their span; see :func:`answered` for ``make``."""
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema.fields], *StructType.fromDDL(ddl).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, table, (files, base) = make(), word_table(outside), fs.FileSystem.from_uri(folder)
        for span in spans(batches, text, outside, adjust, blank, keep=True):
            answers, path = None, _answer_path(base, span.key)
            if len(span.hashes):
                if files.get_file_info(path).type != fs.FileType.File:
                    raise ValueError("a span of documents has no answers: the input changed between two reads; store it first")
                with files.open_input_stream(path) as stored_answers:
                    answers = unpacked(pa.scalar(stored_answers.read(), pa.binary()))
            while span.batches:
                part, hashes, place = span.batches.pop(0)
                texts = text_of(part.column(part.schema.get_field_index(text)), blank)
                chunk = adjust(next(chunks(texts, table, None, 1 << 40)))
                own = answers.take(pa.array(np.searchsorted(span.hashes, hashes))).combine_chunks() if len(hashes) else None
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(chunk, place, own, part)], names)
            pa.default_memory_pool().release_unused()

    return map_arrow(df, run, schema)
