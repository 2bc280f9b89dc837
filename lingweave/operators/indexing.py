"""Dense row numbers, batches and seeded shuffles without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lingweave.functions.rng import digest
from lingweave.session import estimated_bytes, reliable_checkpoint

BATCH_SIZE = 32  # fixed value: rows per batch
BROADCAST_OFFSETS = 1_000_000  # offset rows sent to every task; more are joined by shuffle


def range_partitions(df: DataFrame, bytes_per_partition: int = 32 << 20) -> int:
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = min(most, spark.sparkContext.defaultParallelism)
    return max(least, min(most, estimated_bytes(df) // bytes_per_partition))


def row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    per: Sequence[str] = (),
    name: str = "row_index",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add 0, 1, 2, ... in ``order`` within each ``per`` group.

    One range shuffle sorts the rows over all tasks; each row then knows its place
    in its partition, and partition sizes (at most partitions plus groups rows, so
    small enough to send unless groups are counted by the million) give the offsets. The order must be total, so that a group or a key
    with a third of all rows still divides into ranges. The placed rows are
    checkpointed, since a place must not change when a task is run again: name the
    columns to ``keep``, so that long sort keys end with the sort.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(range_partitions(df), *per, *keys)
    placed = reliable_checkpoint(
        ranged.sortWithinPartitions(*per, *keys).select(*(keep or df.columns), F.monotonically_increasing_id().alias("_slot"))
    )
    placed = placed.withColumn("_part", F.shiftright("_slot", 33))
    sizes = placed.groupBy(*per, "_part").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *per,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    if not per or sizes.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, [*per, "_part"])
        .withColumn(name, F.col("_slot") + F.col("_shift"))
        .drop("_slot", "_part", "_shift")
    )


def run_starts(df: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """Add the place at which a row's run of ``count`` rows begins, runs laid end to end in the order of ``key``.

    As :func:`row_index` of the runs' rows, without making them: only keys are ranged. Keys must differ.
    """
    ranged = df.repartitionByRange(range_partitions(df), key)
    placed = reliable_checkpoint(ranged.select("*", F.spark_partition_id().alias("_part")))
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    sums = placed.groupBy("_part").agg(F.sum(count).alias("_n"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(count).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_inside") + F.col("_shift"))
        .drop("_part", "_inside", "_shift")
    )


def with_batches(df: DataFrame, index: str = "row_index", size: int = BATCH_SIZE) -> DataFrame:
    """Number consecutive runs of ``size`` rows."""
    return df.withColumn("batch_id", F.floor(F.col(index) / size))


def loader_order(split: str, row: str, seed: int, shuffled: Sequence[str] = ("train",)) -> list[Column]:
    """Order of a loader: seeded shuffle for the splits named, row order for the rest."""
    mixed = F.when(F.col(split).isin(*shuffled), digest(seed, "shuffle", F.col(row)))
    return [F.coalesce(mixed, F.lit("")), F.col(row)]


def first_rows(df: DataFrame, n: int = BATCH_SIZE, index: str = "row_index") -> DataFrame:
    """The overfit subset: rows with index below ``n``."""
    return df.where(F.col(index) < n)


def row_range(df: DataFrame, first: int | None, last: int | None, row: str = "row_id") -> DataFrame:
    """Label slice, both ends included; ``None`` leaves an end open."""
    if first is not None:
        df = df.where(F.col(row) >= first)
    return df if last is None else df.where(F.col(row) <= last)


def label_ranges(df: DataFrame, starts: Sequence[int], row: str = "row_id") -> DataFrame:
    """Number the consecutive label slices that begin at ``starts``; the last one is open."""
    number = F.lit(-1)
    for i, start in enumerate(starts):
        number = F.when(F.col(row) >= start, F.lit(i)).otherwise(number)
    return df.withColumn("range_no", number)


def split_stats(df: DataFrame, split: str = "split", size: int = BATCH_SIZE) -> DataFrame:
    """Rows and batches per split."""
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.ceil(F.count("*") / size).cast("long").alias("batches")
    )
