"""SentencePiece encoding and decoding by a relational lattice.

A text gets a blank in front and its blanks become word marks. A unit is a word with the blanks
before it; no piece of the vocabulary has a mark after another character, so none crosses units,
and white space that is in no piece stands between units. Distinct units go to the task
that owns their hash range (see ``exchange``). There, substrings of bounded length are
exploded and equi-joined to the piece table, the matches are grouped by unit, and a higher-order
``aggregate`` folds them, sorted by their end, into the best segmentation (Viterbi with the
scores stored in the vocabulary). Each unit is segmented once for the whole corpus, its ids go
back to the spans of documents as files, and the white space between units is filled in. A character without a
piece scores 10 below the lowest piece and becomes its UTF-8 byte pieces.

Decoding joins the bytes of pieces, marks as blanks, and drops the first blank, which gives
the text back. A word mark in the text itself has no piece of its own and becomes bytes too.

Cases: null and empty texts have no pieces and decode to empty texts; repeated rows are encoded alike;
of segmentations with equal scores the one whose last piece is longer is taken; empty tables give no rows;
a unit of any length is one lattice; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm import exchange as X
from lingweave.llm.lattice import MARK, load_pieces
from lingweave.llm.lines import shared_folder
from lingweave.llm.text import WHITE, Chunk, add_columns, input_bytes
from lingweave.session import stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0  # fixed value: a character without a piece scores this much below the lowest piece
HEAD = 3  # characters that bound how long a piece can go on
UNIT_BYTES = 1 << 20  # input per hash range, up to MOST_SMALL of them; distinct units grow slower than the text, so larger inputs need no more
MOST_SMALL = 256
SHORT = 256  # characters up to which substrings are cut from the string itself

ADDED = "ids array<int>"


def live_pieces(vocabulary: str = VOCABULARY) -> list[tuple[str, int, float]]:
    """``piece, id, score`` of the pieces that a best segmentation can hold.

    A piece whose own text scores higher in shorter pieces is on no best path, since the
    shorter pieces could always stand in for it; it need not be looked up.
    """
    table = {t: (i, float(s)) for i, (t, s, k) in enumerate(zip(*load_pieces(vocabulary))) if k == "piece"}
    lowest = min((s for _, s in table.values()), default=0.0) - UNKNOWN_PENALTY
    live: dict[str, float] = {}
    for piece in sorted(table, key=len):
        best = [0.0] + [-np.inf] * len(piece)
        for end in range(1, len(piece) + 1):
            for start in range(end):
                part = piece[start:end]
                if part != piece and (part in live or len(part) == 1):
                    best[end] = max(best[end], best[start] + live.get(part, lowest))
        if len(piece) == 1 or table[piece][1] >= best[-1]:
            live[piece] = table[piece][1]
    return [(piece, *table[piece]) for piece in live]


def separators(vocabulary: str = VOCABULARY) -> list[int]:
    """White space, other than the blank, that is in no piece."""
    used = {c for t, k in zip(*load_pieces(vocabulary)[::2]) if k == "piece" for c in t.encode()}
    return [c for c in WHITE if c != 0x20 and c not in used]


def edges(units: DataFrame, pieces: list[tuple[str, int, float]], unknown: float) -> DataFrame:
    """``owner, no, end, start, id, score``: every substring that is a piece, and every character.

    Substrings are as long as the longest piece that begins with the same characters.
    """
    spark = units.sparkSession
    longest, bounds = max((len(p) for p, *_ in pieces), default=1), {}
    for piece, *_ in pieces:
        if len(piece) > HEAD:
            bounds[piece[:HEAD]] = max(bounds.get(piece[:HEAD], 0), len(piece))
    # both are at most a vocabulary: tens of thousands of rows, whatever the corpus
    table = F.broadcast(spark.createDataFrame(pieces, "piece string, id int, score double"))
    heads = F.broadcast(spark.createDataFrame(list(bounds.items()), "head string, most int"))
    # a substring is cut from the next few characters, so its cost does not depend on where it begins
    size = F.char_length("unit")
    long_unit = F.when(size > SHORT, F.split("unit", ""))
    starts = units.select("owner", "no", "unit", long_unit.alias("chars"), F.explode(F.sequence(F.lit(1), size)).alias("start"))
    ahead = F.when(F.col("chars").isNull(), F.substring("unit", F.col("start"), F.lit(longest))).otherwise(
        F.array_join(F.slice("chars", F.col("start"), F.lit(longest)), "")
    )
    starts = starts.select("owner", "no", "start", ahead.alias("ahead"))
    starts = starts.withColumn("head", F.substring("ahead", F.lit(1), F.lit(HEAD))).join(heads, "head", "left")
    room = F.least(F.char_length("ahead"), F.coalesce("most", F.lit(HEAD)))
    spans = starts.select("owner", "no", "start", "ahead", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    cut = spans.select("owner", "no", "start", "size", F.substring("ahead", F.lit(1), F.col("size")).alias("piece"))
    found = cut.join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    return found.select(
        "owner",
        "no",
        (F.col("start") + F.col("size") - 1).alias("end"),
        (F.col("start") - 1).alias("start"),
        F.coalesce("id", -1 - F.ascii("piece")).alias("id"),  # a character without a piece is named by its code point
        F.coalesce("score", F.lit(unknown)).alias("score"),
    )


def best_scores(matches: Column) -> Column:
    """Best ``struct<score,start,id>`` of every end, from ``array<struct<end,start,id,score>>`` sorted by end and start."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(-1).alias("id")))

    def step(best: Column, m: Column) -> Column:
        score = F.get(best, m["start"])["score"] + m["score"]
        reached = F.array(F.struct(score.alias("score"), m["start"].alias("start"), m["id"].alias("id")))
        return (
            F.when(F.size(best) == m["end"], F.concat(best, reached))
            .when(score > F.get(best, m["end"])["score"], F.concat(F.slice(best, F.lit(1), m["end"]), reached))
            .otherwise(best)
        )

    return F.aggregate(matches, first, step)


def best_path(best: Column) -> Column:
    """Ids of the segmentation, followed back from the last end.

    ``best`` must be a stored column: inside a fold an expression would be computed at every step.
    """
    path = F.struct(F.array().cast("array<int>").alias("path"), (F.size(best) - 1).alias("at"))

    def back(state: Column, node: Column) -> Column:
        more = F.struct(F.concat(F.array(node["id"]), state["path"]).alias("path"), node["start"].alias("at"))
        return F.when(node["end"] == state["at"], more).otherwise(state)

    ends = F.transform(best, lambda b, i: F.struct(i.alias("end"), b["start"].alias("start"), b["id"].alias("id")))
    return F.aggregate(F.reverse(F.slice(ends, F.lit(2), F.size(best))), path, back, lambda s: s["path"])


def segment(units: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``owner, no, path`` of distinct ``owner, no, unit`` rows; stays in the partitions of ``owner``."""
    texts, scores, kinds = load_pieces(vocabulary)
    if any(" " in t for t, k in zip(texts, kinds) if k == "piece"):
        raise ValueError(f"a piece of {vocabulary} holds a blank, which stands for literal word marks here")
    unknown = min((s for s, k in zip(scores, kinds) if k == "piece"), default=0.0) - UNKNOWN_PENALTY
    found = edges(units, live_pieces(vocabulary), unknown)
    match = F.struct("end", "start", "id", "score")
    grouped = found.groupBy("owner", "no").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    best = grouped.select("owner", "no", best_scores(F.col("matches")).alias("best"))
    return best.select("owner", "no", best_path(F.col("best")).alias("path"))


def by_owner(rows: DataFrame, count: int) -> DataFrame:
    """The rows of every ``owner`` from 0 to ``count`` in a partition of their own."""
    return rows.withColumn("owner", F.col("owner").cast("int")).repartitionById(count, "owner")


def ranges(docs: DataFrame) -> int:
    """Number of hash ranges; one also holds the lattice of its units, which should neither spill nor fill the executor."""
    return max(X.owners(docs) * 4, min(MOST_SMALL, (input_bytes(docs) or 0) // UNIT_BYTES))


def path_ids(paths: pa.Array, first_byte: int) -> pa.Array:
    """Piece ids of segmentations; a character without a piece gives its bytes, a blank those of a word mark."""
    ids, offsets = paths.flatten().to_numpy(zero_copy_only=False), paths.offsets.to_numpy()
    offsets = offsets - offsets[0]
    unknown = np.flatnonzero(ids < 0)
    if not len(unknown):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
    spell = {int(i): [b + first_byte for b in (MARK if i == -1 - 0x20 else chr(-1 - i)).encode()] for i in np.unique(ids[unknown])}
    spelt = {int(i): spell[int(ids[i])] for i in unknown}
    size = np.ones(len(ids), np.int64)
    size[unknown] = [len(spelt[int(i)]) for i in unknown]
    ends = np.cumsum(size)
    flat = np.repeat(ids, size)
    for i, values in spelt.items():
        flat[ends[i] - len(values) : ends[i]] = values
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[offsets], pa.int32()), pa.array(flat, pa.int32()))


def split_at_blanks(chunk: Chunk) -> Chunk:
    """Words that hold blanks become units: blanks and the word after them."""
    if not len(chunk.starts):
        return chunk
    blank = chunk.data == 0x20
    opens, closes = np.zeros(len(blank) + 1, bool), np.zeros(len(blank) + 1, bool)
    # a blank after another character of the same word ends one unit and begins the next
    opens[1:-1] = blank[1:] & ~blank[:-1]
    covered = np.zeros(len(blank) + 1, np.int8)
    covered[chunk.starts] += 1
    np.subtract.at(covered, chunk.ends, 1)
    inside = np.cumsum(covered, dtype=np.int8) > 0
    opens &= inside
    opens[chunk.starts] = False
    closes |= opens
    opens[chunk.starts], closes[chunk.ends] = True, True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return Chunk(chunk.first, chunk.data, chunk.offsets, starts, ends, np.searchsorted(chunk.offsets, starts, "right") - 1)


class Speller:
    """Texts of piece ids: marks as blanks, bytes as they are, nothing for control pieces."""

    def __init__(self, spelling: list[bytes]):
        self.size = np.array([len(t) for t in spelling], np.int64)
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelling), np.uint8)

    @staticmethod
    def spelling(vocabulary: str) -> list[bytes]:
        texts, _, kinds = load_pieces(vocabulary)
        return [bytes([int(t[3:5], 16)]) if k == "byte" else t.replace(MARK, " ").encode() if k == "piece" else b"" for t, k in zip(texts, kinds)]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """One text per run of ids, without the blank that encoding puts in front."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[ids], size)].tobytes()
        cuts = ends[offsets]
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:])]


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, decoded: str | None = None) -> DataFrame:
    """Add ``ids``, the pieces of the text; ``decoded`` names a column for the text they give back."""
    spark = docs.sparkSession
    kinds = load_pieces(vocabulary)[2]
    first_byte, outside = kinds.index("byte"), separators(vocabulary)
    added = ADDED + (f", `{decoded}` string" if decoded else "")
    spelling = spark.sparkContext.broadcast(Speller.spelling(vocabulary)) if decoded else None
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("ids", decoded)])
    count = ranges(docs)
    sent = X.words_by_span(docs, text, count, outside=outside, adjust=split_at_blanks, blank=True)
    owned = stored(X.owned(sent), "pieces-units")

    # one exchange, a task for every owner: hashed, some tasks would sort the edges of four; the lattice and the grouping of its edges stay there
    words = by_owner(owned.where("batch is null").select("owner", "words"), count)
    units = words.select("owner", F.posexplode("words").alias("no", "word"))
    segmented = segment(units.select("owner", "no", F.translate("word", " " + MARK, MARK + " ").alias("unit")), vocabulary)

    def respond(asked: pa.Table, paths: pa.Table) -> pa.Table:
        return X.answer_rows(asked, pa.table({"ids": path_ids(paths.sort_by("no")["path"].combine_chunks(), first_byte)}))

    segmented = segmented.select(F.col("owner").alias("_owner"), "no", "path")
    places = by_owner(owned.where("batch is not null").select("owner", "batch", "place"), count)
    folder = shared_folder(spark, "pieces-answers")
    X.store_answers(places.groupBy("owner").cogroup(segmented.groupBy("_owner")).applyInArrow(respond, X.ANSWER), folder)

    def make() -> Callable:
        speller = Speller(spelling.value) if decoded else None

        def columns(chunk: Chunk, place: np.ndarray, answers: pa.Table | None, rows: pa.Table) -> list[pa.Array]:
            lists = answers["ids"].combine_chunks() if answers else pa.array([], pa.list_(pa.int32()))
            sizes, ids = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            covered = np.zeros(len(chunk.data) + 1, np.int8)
            covered[chunk.starts] += 1
            np.add.at(covered, chunk.ends, -1)
            free = np.flatnonzero(np.cumsum(covered[:-1]) == 0)  # white space outside units
            position = np.concatenate([chunk.starts, free])
            order = np.argsort(position, kind="stable")
            first = np.concatenate([(np.cumsum(sizes) - sizes)[place] if len(place) else np.zeros(0, np.int64), len(ids) + np.arange(len(free))])[order]
            size = np.concatenate([sizes[place] if len(place) else np.zeros(0, np.int64), np.ones(len(free), np.int64)])[order]
            values = np.concatenate([ids, chunk.data[free].astype(np.int64) + first_byte])
            ends = np.cumsum(size)
            flat = values[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)]
            per_text = np.searchsorted(position[order], chunk.offsets)
            offsets = np.concatenate([[0], ends])[per_text]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            return [lists, pa.array(speller.texts(flat, offsets), pa.string())] if speller else [lists]

        return columns

    return X.answered_in_place(docs, text, folder, added, make, outside=outside, adjust=split_at_blanks, blank=True)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the text of piece ids; control pieces have none, byte sequences that are no UTF-8 are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(Speller.spelling(vocabulary))

    def make() -> Callable:
        speller = Speller(shared.value)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            own = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            return [pa.array(speller.texts(own, np.concatenate([[0], np.cumsum(sizes)])), pa.string())]

        return columns

    return add_columns(df, f"`{out}` string", make)


def same_text(text: str, decoded: str) -> Column:
    """Does the decoded text equal the text? A null text is an empty one."""
    return F.coalesce(F.col(text), F.lit("")) == F.col(decoded)
