"""Token counts by section: whole texts are encoded once, tokens are attributed by their offsets.

A text goes through the byte-level vocabulary once. Token byte lengths give offsets into the
text, and an interval join within the text (one sorted search) finds the sections that a
token touches. A token that crosses a border goes to one section by an explicit rule:
``first`` the section of its first byte, ``last`` of its last byte, ``most`` the one with
most of its bytes, the earlier one on a tie. So section counts add up to the text's count.

Sections are the lines of the text, each with its line feed, or the spans given in a column
``array<struct<start:bigint,end:bigint>>`` of code points, sorted and without overlap; bytes
outside all spans count as ``unattributed``. Fields of a record are sections of their
concatenation: see ``attribute_fields``.

Cases: a null or empty text has no tokens and no sections (lines); null spans count as none;
repeated rows and ids are counted alike; empty tables give no rows; texts of any length are
encoded whole; input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingweave.llm.text import add_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")

ADDED = "n_tokens bigint, n_sections bigint, section_tokens array<bigint>, n_crossing bigint, unattributed bigint"


def load_ranks(data: bytes):
    """An encoder, and the number of bytes of every token."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("stored", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(data: np.ndarray) -> np.ndarray:
    """First byte of every line; a line ends with its line feed."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[starts < len(data)]


def byte_positions(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Byte position of code point positions; those past the end give the length."""
    first = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    return first[np.clip(points, 0, len(first) - 1)]


def attribute(starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, closes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token (-1 outside all) and whether it touches more than one place.

    Tokens and sections are byte intervals, both sorted and without overlap.
    """
    if not len(opens):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)

    def section(at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(opens, at, "right") - 1
        inside = (found >= 0) & (at < closes[np.maximum(found, 0)])
        return np.where(inside, found, -1)

    first, last = section(starts), section(ends - 1)
    low = np.searchsorted(closes, starts, "right")  # first section that ends after the token begins
    high = np.searchsorted(opens, ends, "left")  # first section that begins after the token
    crossing = (first != last) | (high - low > 1)
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for t in np.flatnonzero(crossing):
        sections = np.arange(low[t], high[t])
        if len(sections):
            shared = np.minimum(closes[sections], ends[t]) - np.maximum(opens[sections], starts[t])
            chosen[t] = sections[np.argmax(shared)]
    return chosen, crossing


def count_tokens(docs: DataFrame, text: str = "text", spans: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the number of tokens, of sections, of tokens per section, of crossing and of unattributed tokens."""
    if rule not in RULES:
        raise ValueError(f"rule {rule}: one of {', '.join(RULES)}")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as stored:
        shared = spark.sparkContext.broadcast(stored.read())

    def make() -> Callable:
        encoder, lengths = load_ranks(shared.value)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            given = batch.column(batch.schema.get_field_index(spans)).to_pylist() if spans else [None] * len(texts)
            totals, per, crossings, outside = [], [], [], []
            for value, own in zip(texts, given):
                ends = np.cumsum(lengths[encoder.encode_to_numpy(value)]) if value else np.zeros(0, np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                data = np.frombuffer((value or "").encode(), np.uint8)
                if spans:
                    edges = np.array([(s["start"], s["end"]) for s in own or ()], np.int64).reshape(-1, 2)
                    opens, closes = byte_positions(data, edges[:, 0]), byte_positions(data, edges[:, 1])
                else:
                    opens = line_starts(data)
                    closes = np.append(opens[1:], len(data)) if len(opens) else opens
                section, crossing = attribute(starts, ends, opens, closes, rule)
                totals.append(len(ends))
                per.append(np.bincount(section[section >= 0], minlength=len(opens)))
                crossings.append(int(crossing.sum()))
                outside.append(int((section < 0).sum()))
            sizes = [len(p) for p in per]
            return [
                pa.array(totals, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *per]).astype(np.int64))
                ),
                pa.array(crossings, pa.int64()),
                pa.array(outside, pa.int64()),
            ]

        return columns

    return add_columns(docs, ADDED, make)


def attribute_fields(df: DataFrame, fields: Sequence[str], separator: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of the fields of a record, encoded as one text; ``section_tokens`` is in the order of ``fields``.

    The separator between fields belongs to none. A null field is empty.
    """
    values = [F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for value in values:
        spans.append(F.struct(at.alias("start"), (at + F.length(value)).alias("end")))
        at = at + F.length(value) + len(separator)
    joined = df.withColumn("_text", F.concat_ws(separator, *values)).withColumn("_spans", F.array(*spans))
    return count_tokens(joined, "_text", "_spans", rule, vocabulary).drop("_text", "_spans")
