"""Duplicates and leaks between splits.

Keys are compared through a null-safe SHA-256 digest, so shuffles and sorts move
32 bytes instead of whole texts and null keys match each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ColumnLike = Column | str
# A row found in several splits stays in the first of these only.
SPLIT_PRIORITY = ("validation", "test", "train")


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_digest(*keys: ColumnLike) -> Column:
    """Digest of a composite key; lengths keep fields apart, null differs from empty."""
    parts: list[Column] = []
    for key in keys:
        text = _col(key).cast("string")
        parts += [F.coalesce(F.length(text).cast("string"), F.lit("null")), F.lit(":")]
        parts += [F.coalesce(text, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def keep_first(df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the first in ``order``.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so a
    key with a third of all rows sends at most one row per map task.
    """
    first = Window.partitionBy("_key").orderBy(*[_col(o) for o in order])
    return (
        df.withColumn("_key", key_digest(*keys))
        .withColumn("_copy", F.row_number().over(first))
        .where("_copy = 1")
        .drop("_key", "_copy")
    )


def remove_leaks(df: DataFrame, other: DataFrame, keys: Sequence[ColumnLike]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``; multiplicity is kept.

    The right side shrinks to its distinct digests first. No broadcast is forced:
    Spark picks one when the digests are small, else a sort-merge anti join whose
    left side AQE may split when one key is hot.
    """
    seen = other.select(key_digest(*keys).alias("_key")).distinct()
    return df.withColumn("_key", key_digest(*keys)).join(seen, "_key", "left_anti").drop("_key")


def leak_free_splits(
    df: DataFrame,
    keys: Sequence[ColumnLike],
    order: Sequence[ColumnLike],
    split: str = "split",
    priority: Sequence[str] = SPLIT_PRIORITY,
) -> DataFrame:
    """Deduplicate every split and remove the leaks between them in one shuffle.

    Three dedupes and three anti joins (train minus validation, train minus test,
    test minus validation) keep one row per key: the first row of the split that
    ranks highest. That is a single ``keep_first`` ordered by split, then row.
    """
    ranks = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(split))
    return keep_first(df.where(F.col(split).isin(*priority)), keys, [ranks, *order])


def duplicate_counts(df: DataFrame, keys: Sequence[ColumnLike], *by: str) -> DataFrame:
    """Copies per key: ``by..., _key, copies``; counts combine before the shuffle."""
    return df.groupBy(*by, key_digest(*keys).alias("_key")).agg(F.count("*").alias("copies"))


def duplicate_profile(df: DataFrame, keys: Sequence[ColumnLike], by: str) -> DataFrame:
    """Per ``by`` value: distinct keys, keys with copies, most copies of one key."""
    return (
        duplicate_counts(df, keys, by)
        .groupBy(by)
        .agg(
            F.count("*").alias("keys"),
            F.count_if(F.col("copies") > 1).alias("dup_keys"),
            F.max("copies").alias("max_copies"),
        )
    )
