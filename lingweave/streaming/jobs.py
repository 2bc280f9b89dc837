"""Incremental twins of batch jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from lingweave.operators.cleaning import clean_columns
from lingweave.operators.dedupe import key_digest, remove_leaks
from lingweave.operators.vocab import add_freqs, word_freq
from lingweave.session import delete_path

COMPACT_EVERY = 50  # folders of micro-batches that gather before they become one


def clean_stream(
    stream: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    held_out: DataFrame | None = None,
    event_time: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Drop repeated and leaked pairs of a stream, then clean its text columns.

    With an event time, seen keys are forgotten ``delay`` behind the newest event,
    so state stays bounded; without one every key stays in state.
    """
    if held_out is not None:
        stream = remove_leaks(stream, held_out, keys)
    stream = stream.withColumn("_key", key_digest(*keys))
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])
    else:
        stream = stream.dropDuplicates(["_key"])
    return clean_columns(stream.drop("_key"), columns)


def word_freq_stream(stream: DataFrame, tokens, path: str, every: int = COMPACT_EVERY) -> DataStreamWriter:
    """Keep a word-frequency table at ``path`` in step with a stream.

    Every micro-batch writes its own counts to a folder named by the batch, so a
    batch that runs again replaces its counts instead of adding them twice. Once ``every``
    folders have gathered, those of earlier batches become one. Read the table with :func:`read_word_freq`.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        upto, _ = _folders(spark, path)
        if batch_id <= upto:
            return  # counted in the compacted table already
        word_freq(batch, tokens).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        compact_word_freq(spark, path, batch_id - 1, every)

    return stream.writeStream.foreachBatch(add)


def compact_word_freq(spark: SparkSession, path: str, upto: int, every: int = 1) -> None:
    """Put the counts of batches up to ``upto`` into one table, if there are ``every`` of them.

    The new table counts once it is whole; then what it holds is deleted. A job that stops in
    between leaves folders that the next compaction deletes and no reader opens.
    """
    before, batches = _folders(spark, path)
    old = [b for b in batches if before < b <= upto]
    if len(old) < every:
        return
    parts = [f"{path}/batch={b}" for b in old] + ([f"{path}/upto={before}"] if before >= 0 else [])
    add_freqs(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{path}/upto={old[-1]}")
    for name in _names(spark, path):
        kind, _, number = name.partition("=")
        if (kind == "batch" and int(number) <= old[-1]) or (kind == "upto" and int(number) < old[-1]):
            delete_path(spark, f"{path}/{name}")


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath().getName()) for f in files.listStatus(folder)] if files.exists(folder) else []


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last batch of the newest whole compacted table, -1 without one, and the batches with a folder."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda name: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    names = _names(spark, path)
    tables = sorted((int(n[5:]) for n in names if n.startswith("upto=")), reverse=True)
    upto = next((n for n in tables if whole(f"upto={n}")), -1)
    return upto, sorted(int(n[6:]) for n in names if n.startswith("batch=") and whole(n))


def read_word_freq(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all batches: the compacted table and the folders after it."""
    upto, batches = _folders(spark, path)
    parts = [f"{path}/batch={b}" for b in batches if b > upto] + ([f"{path}/upto={upto}"] if upto >= 0 else [])
    return add_freqs(spark.read.schema("word string, freq long").parquet(*parts)) if parts else spark.createDataFrame([], "word string, freq long")
