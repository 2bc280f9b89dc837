"""Processed-corpus tables and the answer log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lingweave.functions.whitespace import strip


def write_corpus(df: DataFrame, path: str, remove: bool = True, by: str = "split", fmt: str = "parquet") -> None:
    """Store a corpus partitioned by split.

    ``remove`` replaces what is there; otherwise an existing table stays as it is
    and :func:`read_corpus` returns that one.
    """
    mode = "overwrite" if remove else "ignore"
    writer = df.write.mode(mode).partitionBy(by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def read_corpus(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a stored corpus; a filter on split reads that folder only."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, escape='"', multiLine=True)
    return reader.load(path)


def append_answers(df: DataFrame, path: str, answer: str, row: str = "row_id", run: str | None = None) -> None:
    """Append answers to a text log, one ``row_id<TAB>answer`` line each, line feeds removed.

    Every append has a folder of its own. One that is named by ``run`` and repeated after a failure
    replaces what it wrote before, so no answer stands in the log twice.
    """
    flat = F.replace(F.col(answer), F.lit("\n"), F.lit(""))
    line = F.concat_ws("\t", F.col(row).cast("string"), flat)
    df.select(line.alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}/run={run or uuid.uuid4().hex}", lineSep="\n")


def read_answers(spark: SparkSession, path: str, row_type: str = "string") -> DataFrame:
    """``row_id, line`` of an answer log, lines stripped at both ends."""
    tab = F.instr("value", "\t")
    return spark.read.text(path, lineSep="\n", recursiveFileLookup=True).select(
        F.substring(F.col("value"), F.lit(1), tab - 1).cast(row_type).alias("row_id"),
        strip(F.substring(F.col("value"), tab + 1, F.length("value"))).alias("line"),
    )


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
