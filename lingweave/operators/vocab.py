"""Word counts, vocabularies and token-id lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lingweave.functions.arrays import MASK_TOKEN, SPECIAL_TOKENS, UNK
from lingweave.functions.tokens import byte_alphabet
from lingweave.functions.whitespace import ws_tokens
from lingweave.operators.indexing import row_index
from lingweave.session import small_batches, stored

# A vocabulary above this many tokens is joined instead of sent to every task.
BROADCAST_TOKENS = 1_000_000


def word_freq(df: DataFrame, tokens: Column) -> DataFrame:
    """``word, freq``. Counts combine before the shuffle, so a hot word is one row per task."""
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def add_freqs(*tables: DataFrame) -> DataFrame:
    """Sum frequency tables, as when new text arrives."""
    total = tables[0]
    for table in tables[1:]:
        total = total.unionByName(table)
    return total.groupBy("word").agg(F.sum("freq").alias("freq"))


def char_vocab(df: DataFrame, text: Column) -> DataFrame:
    """Distinct characters; every row emits each of its characters once."""
    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    return df.select(F.explode(chars).alias("ch")).distinct()


def token_totals(df: DataFrame, split: str, columns: Sequence[str], count=None) -> DataFrame:
    """``split, column, tokens`` for every text column in one pass."""
    count = count or (lambda c: F.size(ws_tokens(c)))
    sums = df.groupBy(split).agg(*[F.sum(count(F.col(c)).cast("long")).alias(c) for c in columns])
    return sums.unpivot(split, list(columns), "column", "tokens")


def ranked_vocab(freq: DataFrame, size: int, mask: bool = True) -> DataFrame:
    """``id, token``: specials, the ``size`` commonest words, then the mask token.

    The top-k sort keeps ``size`` rows per task; the numbering window sees the
    ``size`` winners only. A word spelt like a special token is not added again.
    """
    fixed = [*SPECIAL_TOKENS, MASK_TOKEN]
    spark = freq.sparkSession
    best = freq.where(~F.col("word").isin(fixed)).orderBy(F.desc("freq"), "word").limit(size)
    last = spark.createDataFrame([(MASK_TOKEN, -1)] if mask else [], "word string, freq long")
    place = F.row_number().over(Window.orderBy(F.desc("freq"), "word")) + (len(SPECIAL_TOKENS) - 1)
    words = best.unionByName(last).select(place.alias("id"), F.col("word").alias("token"))
    return spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id int, token string").unionByName(words)


def append_tokens(vocab: DataFrame, tokens: DataFrame, order: Sequence[str | Column] = ("token",)) -> DataFrame:
    """Add the ``tokens`` the vocabulary lacks, numbered after its highest id.

    Both inputs are stored, since the plan reads them several times and would count
    the words of a corpus again each time.
    """
    vocab = stored(vocab, "vocab")
    new = stored(tokens.join(vocab.select("token"), "token", "left_anti"), "new-tokens")
    last = vocab.agg(F.max("id")).first()[0]
    numbered = row_index(new, order, name="_at")
    return vocab.unionByName(numbered.select((F.col("_at") + last + 1).cast("int").alias("id"), "token"))


def style_vocab(style: str, base: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """Vocabulary of a tokeniser style: ``DEFAULT`` base, ``SCRATCH`` trained, ``APPEND`` both."""
    if style == "DEFAULT":
        return base
    if trained is None:
        raise ValueError(f"style {style} needs a trained vocabulary")
    if style == "SCRATCH":
        return trained
    if style == "APPEND":
        return append_tokens(base, trained.select("token", F.col("id").alias("_order")), ["_order"])
    raise ValueError(f"unknown style {style}")


def byte_vocab(merged: Sequence[str], spark) -> DataFrame:
    """``id, token`` of a byte-level vocabulary: specials, bytes, merges, mask."""
    tokens = [*SPECIAL_TOKENS, *byte_alphabet(len(SPECIAL_TOKENS)), *merged, MASK_TOKEN]
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string")


class TokenLookup:
    """Token to id and back, with equal results for vocabularies of any size.

    At most ``limit`` tokens go to the tasks, where Arrow's hash kernel looks up a whole
    batch at once. A larger vocabulary is joined. ``words`` splits texts.
    """

    def __init__(self, vocab: DataFrame, limit: int = BROADCAST_TOKENS, words: Callable[..., Column] = ws_tokens):
        rows = vocab.select("id", "token").limit(limit + 1).toArrow()
        self.vocab = vocab.select("id", "token")
        self._words = words
        self._shared = None
        names = [*SPECIAL_TOKENS, MASK_TOKEN]
        if rows.num_rows <= limit:
            rows = rows.sort_by("id")
            self._shared = vocab.sparkSession.sparkContext.broadcast((rows["id"].to_pylist(), rows["token"].to_pylist()))
            # asking the vocabulary again would count the words of its corpus again
            found = rows.filter(pc.is_in(rows["token"], value_set=pa.array(names))).to_pylist()
        else:
            found = self.vocab.where(F.col("token").isin(names)).toArrow().to_pylist()  # at most five rows
        self._special = {r["token"]: r["id"] for r in found}

    def special_ids(self) -> list[int]:
        return sorted(self._special.values())

    def id_of(self, token: str) -> int:
        """Id of a special token."""
        return self._special[token]

    def encoded(self, df: DataFrame, text: str, out: str, most: int | None = None) -> DataFrame:
        """Add the ids of the (first ``most``) words of a text."""
        whole = F.coalesce(F.col(text), F.lit(""))
        # splitting stops once the rest would be cut off
        return self.with_ids(df, self._words(whole) if most is None else F.slice(self._words(whole, most + 2), 1, most), out)

    def decoded(self, df: DataFrame, ids: str, out: str) -> DataFrame:
        """Add the text of ids: words joined by blanks."""
        return self.with_tokens(df, F.col(ids), "_words").withColumn(out, F.array_join("_words", " ")).drop("_words")

    def with_ids(self, df: DataFrame, tokens: Column, out: str, unknown: int = UNK) -> DataFrame:
        """Add the ids of an array of tokens."""
        if self._shared:
            return df.withColumn(out, self._to_ids(tokens, unknown))
        return _by_join(df, tokens, self.vocab.select(F.col("token").alias("_key"), F.col("id").alias("_value")), out, F.lit(unknown))

    def with_tokens(self, df: DataFrame, ids: Column, out: str) -> DataFrame:
        """Add the tokens of an array of ids; an unknown id has a null token."""
        if self._shared:
            return df.withColumn(out, self._to_tokens(ids))
        return _by_join(df, ids, self.vocab.select(F.col("id").alias("_key"), F.col("token").alias("_value")), out, F.lit(None))

    def _to_ids(self, tokens: Column, unknown: int) -> Column:
        small_batches(self.vocab.sparkSession)
        shared = self._shared

        @F.arrow_udf("array<int>")
        def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids, words = (pa.array(v) for v in shared.value)
            ids = ids.cast(pa.int32())
            for batch in batches:
                found = pc.take(ids, pc.index_in(batch.flatten(), value_set=words))
                yield _like(batch, pc.fill_null(found, unknown))

        return lookup(tokens)

    def _to_tokens(self, ids: Column) -> Column:
        small_batches(self.vocab.sparkSession)
        shared = self._shared

        @F.arrow_udf("array<string>")
        def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            keys, words = (pa.array(v) for v in shared.value)
            keys = keys.cast(pa.int32())
            for batch in batches:
                yield _like(batch, pc.take(words, pc.index_in(batch.flatten(), value_set=keys)))

        return lookup(ids)


def _like(lists: pa.Array, values: pa.Array) -> pa.Array:
    """A list array shaped as ``lists`` with new flat values."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def _by_join(df: DataFrame, keys: Column, table: DataFrame, out: str, missing: Column) -> DataFrame:
    """Replace an array of keys by the values of a ``_key, _value`` table too large to send.

    Elements are exploded, joined and put together per row. The other columns travel with
    the first element only.
    """
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_all"), keys.alias("_keys"))
    long = rows.select("_row", "_all", F.posexplode_outer("_keys").alias("_pos", "_key"))
    long = long.withColumn("_all", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_all")))
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_value", missing).alias("value")))
    found = long.join(table, "_key", "left").groupBy("_row").agg(
        F.first("_all", ignorenulls=True).alias("_all"), F.sort_array(F.collect_list(item)).alias("_items")
    )
    return found.select("_all.*", F.transform("_items", lambda s: s["value"]).alias(out))
