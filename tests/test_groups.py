"""Ordered folds and functions per batch against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingweave.operators import groups

SEEN = groups.Fold(list, lambda s, f: s + f["x"].tolist(), lambda a, b: a + b, lambda s: {"n": len(s), "all": ",".join(map(str, s))})


@pytest.fixture(scope="module")
def rows(spark):
    """One group with a third of all rows, a null group, and many small ones."""
    rng = np.random.default_rng(4)
    data = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"g{rng.integers(200)}", i % 2 == 0, int(i), int(rng.integers(1000))) for i in rng.permutation(6000).tolist()]
    return spark.createDataFrame(data, "g string, even boolean, at long, x long")


@pytest.mark.parametrize("arrow_rows", [7, 10_000])
def test_fold_sees_every_row_in_order(spark, rows, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = groups.fold_by_group(rows.repartition(5), ["g", "even"], ["at"], SEEN, {"n": "long", "all": "string"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {}
    for key, part in rows.toPandas().sort_values("at").groupby(["g", "even"], dropna=False):
        expected[None if pd.isna(key[0]) else key[0], bool(key[1])] = (len(part), ",".join(map(str, part["x"])))
    assert {(r.g, r.even): (r.n, r["all"]) for r in got} == expected and len(got) == len(expected)


def test_a_hot_group_is_in_several_tasks(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    parts = []
    try:
        fold = groups.Fold(lambda: 0, lambda s, f: s + 1, lambda a, b: a + b, lambda s: {"stretches": s})
        got = groups.fold_by_group(rows, ["g"], ["at"], fold, {"stretches": "int"}).where("g = 'hot'").collect()
        parts = [r.stretches for r in got]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts[0] > 1


def test_empty(spark, rows):
    none = rows.where("x < 0")
    assert groups.fold_by_group(none, ["g"], ["at"], SEEN, {"n": "long", "all": "string"}).count() == 0
    assert groups.apply_by_batch(none, "at", ["x"], lambda f: f, none.schema).count() == 0


@pytest.mark.parametrize("arrow_rows", [5, 10_000])
def test_function_gets_whole_batches(spark, rows, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    batched = rows.withColumn("batch_id", F.floor(F.col("at") / 32))
    try:
        shown = lambda f: pd.DataFrame({"batch_id": [f["batch_id"].iloc[0]], "n": [len(f)], "order": [",".join(map(str, f["at"]))]})
        got = groups.apply_by_batch(batched, "batch_id", ["at"], shown, "batch_id long, n int, order string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.batch_id, r.n) for r in got) == [(b, 32 if b < 187 else 16) for b in range(188)]
    assert all(r.order == ",".join(str(i) for i in range(r.batch_id * 32, r.batch_id * 32 + r.n)) for r in got)
