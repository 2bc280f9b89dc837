"""Cleaning as corpus jobs: clean columns, report what each rule did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lingweave.functions.clean import clean_rules, clean_text


def clean_columns(df: DataFrame, columns: Sequence[str], **options: bool) -> DataFrame:
    """Clean the text columns named, leave the others."""
    return df.withColumns({c: clean_text(F.col(c), **options) for c in columns})


def clean_report(df: DataFrame, text: str, by: str, **options: bool) -> DataFrame:
    """``by, rule, rows_changed, chars_removed`` for every rule of the chain, in one scan.

    Each rule sees the output of the rule before it. Rows shrink to two integers
    per rule before the shuffle.
    """
    rules = clean_rules(**options)
    stages = df.select(by, F.col(text).alias("_0"))
    for i, (_, rule) in enumerate(rules):
        # earlier stages are reduced to numbers as soon as the next one exists
        stages = stages.withColumn(f"_{i + 1}", rule(F.col(f"_{i}")))
    changes = []
    for i in range(len(rules)):
        before, after = F.col(f"_{i}"), F.col(f"_{i + 1}")
        changes.append((before != after).cast("long").alias(f"rows{i}"))
        changes.append((F.length(before) - F.length(after)).cast("long").alias(f"chars{i}"))
    sums = stages.select(by, *changes).groupBy(by).agg(
        *[F.sum(f"{kind}{i}").alias(f"{kind}{i}") for i in range(len(rules)) for kind in ("rows", "chars")]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"rows{i}").alias("rows_changed"),
                F.col(f"chars{i}").alias("chars_removed"),
            )
            for i, (name, _) in enumerate(rules)
        ]
    )
    return sums.select(by, F.explode(entries).alias("_e")).select(by, "_e.*")
