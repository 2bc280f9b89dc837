"""Byte-pair tokenizers by style: a ready vocabulary, one trained on the corpus, or both.

``DEFAULT`` is the ready vocabulary. ``SCRATCH`` is trained. ``APPEND`` adds the trained tokens that the
ready vocabulary lacks as whole strings, which are looked for in a text before it is split. Trained merges
are stored when a path is given and loaded from there when they exist, so a corpus is trained on once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lingweave.functions.tokens import byte_characters, pretokenize
from lingweave.operators.bpe import BpeTokenizer, Merge, load_merges, piece_ids, save_merges, token_texts, train
from lingweave.operators.vocab import append_tokens
from lingweave.session import small_batches

STYLES = ("DEFAULT", "SCRATCH", "APPEND")
OWN_PIECE = "a1"  # stands before added tokens among the pieces of a text, none of which holds a letter and a digit


class AppendedTokenizer(BpeTokenizer):
    """A tokenizer with more tokens, numbered after its mask; where several match, the first and longest wins."""

    def __init__(self, merges: Sequence[Merge], added: Sequence[str], spark: SparkSession):
        super().__init__(merges, spark)
        known = {*byte_characters(), *token_texts(merges)}
        self.added = [t for t in dict.fromkeys(added) if t and t not in known]

    def _more(self) -> list[bytes]:
        return [b"", *[t.encode() for t in self.added]]

    def ids(self, text: Column) -> Column:
        whole = {OWN_PIECE + t: self.mask_id + 1 + i for i, t in enumerate(self.added)}
        # parts are text, token, text, token, ..., text
        parts = _parted(F.coalesce(text, F.lit("")), self.added, self.spark)
        pieces = F.flatten(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.array(F.concat(F.lit(OWN_PIECE), p))).otherwise(pretokenize(p))))
        return piece_ids(pieces, self.merges, self.spark, whole)

    def vocabulary(self) -> DataFrame:
        more = self.spark.createDataFrame(list(enumerate(self.added)), "at int, token string")
        return append_tokens(super().vocabulary(), more, ["at"])


def _parted(text: Column, tokens: Sequence[str], spark: SparkSession) -> Column:
    """A text cut at the tokens it holds, leftmost and longest first."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(list(tokens))

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for token in shared.value:
            automaton.add_word(token, len(token))
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                parts, at = [], 0
                for start, size in sorted((last + 1 - n, -n) for last, n in automaton.iter(value)) if shared.value else ():
                    if start >= at:
                        parts += [value[at:start], value[start : start - size]]
                        at = start - size
                rows.append([*parts, value[at:]])
            yield pa.array(rows, pa.list_(pa.string()))

    return cut(text)


def build_tokenizer(
    spark: SparkSession,
    style: str = "DEFAULT",
    base: Sequence[Merge] = (),
    words: DataFrame | None = None,
    merges: int = 8000,
    min_frequency: int = 1,
    path: str | None = None,
) -> BpeTokenizer:
    """A tokenizer by style.

    Styles other than ``DEFAULT`` load the merges stored at ``path``; where there are none they
    train on ``words`` (``word, freq``) and store them there. Nothing is stored without a path.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    if style == "DEFAULT":
        return BpeTokenizer(base, spark)
    trained = _stored_merges(spark, path) if path else None
    if trained is None:
        if words is None:
            raise ValueError(f"style {style} needs words to train on, or a path with trained merges")
        trained = train(words, merges, min_frequency)
        if path:
            save_merges(trained, spark, path)
    return BpeTokenizer(trained, spark) if style == "SCRATCH" else AppendedTokenizer(base, [*sorted(byte_characters()), *token_texts(trained)], spark)


def _stored_merges(spark: SparkSession, path: str) -> list[Merge] | None:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return load_merges(spark, path) if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) else None
