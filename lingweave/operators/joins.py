"""Enrichment, prediction attach and pending-row joins, all on explicit keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lingweave.operators.dedupe import key_digest


def enrich(df: DataFrame, lookup: DataFrame, on: str, columns: Sequence[str], expand: bool = False) -> DataFrame:
    """Left join ``columns`` of ``lookup`` on a text key, fan-out kept as a count.

    Equal lookup rows are counted first, so a text with many copies on both sides
    yields one row and a ``copies`` count instead of the product of both groups.
    ``expand`` repeats the rows as a plain join would. The join runs on digests.
    """
    counted = (
        lookup.withColumn("_key", key_digest(on))
        .groupBy("_key", *columns)
        .agg(F.count("*").alias("copies"))
    )
    joined = (
        df.withColumn("_key", key_digest(on))
        .join(counted, "_key", "left")
        .drop("_key")
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
    )
    if not expand:
        return joined
    repeated = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return joined.withColumn("_", repeated).drop("_", "copies")


def attach_predictions(df: DataFrame, answers: DataFrame, row: str = "row_id") -> DataFrame:
    """Attach answers to the rows that have one, by row id instead of position."""
    return df.join(answers, row)


def pending_rows(df: DataFrame, answered: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows without an answer yet; a row answered twice still counts once."""
    return df.join(answered.select(row), row, "left_anti")
