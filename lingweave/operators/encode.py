"""Fixed-length encoding of sentence pairs and decoding back to text."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from lingweave.functions import arrays as A
from lingweave.operators.infer import require_columns


class Tokenizer(Protocol):
    """Words (:class:`TokenLookup`) or byte pairs (:class:`lingweave.operators.bpe.BpeTokenizer`)."""

    def special_ids(self) -> list[int]: ...

    def encoded(self, df: DataFrame, text: str, out: str, most: int | None = None) -> DataFrame: ...

    def decoded(self, df: DataFrame, ids: str, out: str) -> DataFrame: ...


def encode_text(
    df: DataFrame,
    text: str,
    tokenizer: Tokenizer,
    ids: str = "input_ids",
    mask: str | None = "attention_mask",
    max_length: int = A.MAX_LENGTH,
    padded: bool = True,
) -> DataFrame:
    """Add framed, truncated ids of ``text`` and their attention mask."""
    require_columns(df, text)
    df = tokenizer.encoded(df, text, "_ids", max_length - 2).withColumn("_framed", A.frame(F.col("_ids"))).drop("_ids")
    return _padded(df, ids, mask, max_length, padded)


def _padded(df: DataFrame, ids: str, mask: str | None, max_length: int, padded: bool) -> DataFrame:
    if mask:
        df = df.withColumn(mask, A.attention_mask(F.col("_framed"), max_length) if padded else A.repeat(1, F.size("_framed")))
    value = A.pad(F.col("_framed"), max_length) if padded else F.col("_framed")
    return df.withColumn(ids, value).drop("_framed")


def encode_windows(
    df: DataFrame, text: str, tokenizer: Tokenizer, ids: str = "input_ids", window: str = "part", max_length: int = A.MAX_LENGTH
) -> DataFrame:
    """One row per run of ``max_length - 2`` tokens: the whole text, numbered by ``window`` from 0.

    A text without tokens is one window of borders and pads.
    """
    whole = tokenizer.encoded(df, text, "_ids").drop(text)
    return cut_windows(whole, "_ids", ids, window, max_length)


def window_count(ids: Column, max_length: int = A.MAX_LENGTH) -> Column:
    """Windows of a whole text's ids, one at least."""
    return F.greatest(F.ceil(F.size(ids) / (max_length - 2)), F.lit(1)).cast("long")


def cut_windows(
    df: DataFrame, whole: str, ids: str = "input_ids", window: str = "part", max_length: int = A.MAX_LENGTH
) -> DataFrame:
    """Windows of :func:`encode_windows` from the ``whole`` ids of a text, which they replace."""
    size = max_length - 2

    def cut(part: Column) -> Column:
        run = F.slice(whole, (part * size + 1).cast("int"), F.lit(size))
        return F.struct(part.alias(window), run.alias("_cut"))

    # a window carries its own ids only, so a text's cost does not grow with the square of its length
    parts = F.transform(F.sequence(F.lit(0).cast("long"), window_count(F.col(whole), max_length) - 1), cut)
    rows = df.select(*[c for c in df.columns if c != whole], F.inline(parts))
    return _padded(rows.withColumn("_framed", A.frame(F.col("_cut"))).drop("_cut"), ids, None, max_length, True)


def encode_pairs(df: DataFrame, src: str, tgt: str, source: Tokenizer, target: Tokenizer) -> DataFrame:
    """``input_ids, attention_mask, labels`` of a pair; padded labels are ignored."""
    df = encode_text(df, src, source)
    df = encode_text(df, tgt, target, ids="labels", mask=None)
    return df.withColumn("labels", A.ignore_pads(F.col("labels")))


def encode_batch(df: DataFrame, src: str, tgt: str, source: Tokenizer, target: Tokenizer) -> DataFrame:
    """Raw text beside ids and masks of both sides; labels keep their pad ids."""
    df = encode_text(df, src, source, "src_tokenized", "src_attention_mask")
    return encode_text(df, tgt, target, "tgt_tokenized", "tgt_attention_mask")


def decode_ids(df: DataFrame, ids: str, tokenizer: Tokenizer, out: str = "text") -> DataFrame:
    """Add the text of ids: ignored labels become end tokens, special tokens are skipped."""
    kept = F.filter(A.restore_ignored(F.col(ids)), lambda x: ~x.isin(*tokenizer.special_ids()))
    return tokenizer.decoded(df.withColumn("_kept", kept), "_kept", out).drop("_kept")


def pad_batch(df: DataFrame, ids: str, batch: str = "batch_id") -> DataFrame:
    """Pad arrays to the longest of their batch; a batch has a fixed row count."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return (
        df.withColumn("_longest", longest)
        .withColumn("attention_mask", A.attention_mask(F.col(ids), F.col("_longest")))
        .withColumn(ids, A.pad(F.col(ids), F.col("_longest")))
        .drop("_longest")
    )
