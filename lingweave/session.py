"""Session helpers: settings, the shared folder, and table spreading."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = 4 << 20  # that Spark hands to Python at once; its own default of 64 MB suits numbers, not whole texts


def build_session(cores: str = "*", partitions: int = 8, shared: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    ``shared`` is the folder for stored tables and checkpoints.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lingweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or sc.getConf().get(key) or sc.getCheckpointDir()
    if not base:
        raise ValueError(f"set {key} to a folder all executors can reach")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def small_batches(spark: SparkSession) -> None:
    """Let the session hand whole texts to Python some megabytes at a time, whatever the input; a lower setting stays.

    What a task holds beside a batch, ids and places, is many times the batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit.replace("b", "") or " ") > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so lost executors cost no rework."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage", below: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, columnar, true sizes.

    ``below`` puts it into a folder of :func:`temporary_tables`; others stay, since a lazy
    result may still read them, and are the owner of the folder's to clear.
    """
    path = f"{below}/{name}-{uuid.uuid4().hex}" if below else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of Spark's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table through Spark's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one for tables that nobody reads afterwards; deleted at the end."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        delete_path(spark, path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; file sizes for a plain scan. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str, bytes_per_core: int = 32 << 20) -> DataFrame:
    """Hash-spread a scan too small to fill the cluster; a large one is left alone.

    A small file often holds one row group, hence one task. Above
    ``bytes_per_core`` for every core, the scan already splits by itself and
    another shuffle would only cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) >= cores * bytes_per_core:
        return df
    return df.repartition(cores, *keys)
