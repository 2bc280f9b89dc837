"""Deduplication, leaks, indexes and joins on small tables with nulls, ties and hot keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lingweave.operators import dedupe, groups, indexing, infer, joins
from lingweave.operators.infer import require_columns

KEYS = ("hi_en", "en")


@pytest.fixture(scope="module")
def rows():
    """A third of all rows are copies of one pair; some keys hold nulls."""
    rnd = random.Random(7)
    out = []
    for i in range(600):
        if i % 3 == 0:
            key = ("hot", "key")
        else:
            key = (rnd.choice(["a", "b", "c", None, ""]), rnd.choice(["x", "y", None, "z", "", "null"]))
        out.append((i, *key, rnd.choice(["train", "train", "test", "validation"]), rnd.choice(["s1", "s2"])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, hi_en string, en string, split string, source string").repartition(5)


def first_copies(rows):
    seen, kept = set(), []
    for r in sorted(rows):
        if (r[1], r[2], r[3]) not in seen:
            seen.add((r[1], r[2], r[3]))
            kept.append(r)
    return kept


def test_keep_first(table, rows):
    got = dedupe.keep_first(table, [*KEYS, "split"], ["row_id"]).select("row_id").collect()
    assert sorted(r[0] for r in got) == [r[0] for r in first_copies(rows)]


def test_splits_equal_the_three_step_chain(table, rows):
    kept = first_copies(rows)
    keys = {s: {r[1:3] for r in kept if r[3] == s} for s in ("train", "validation", "test")}
    expected = [r[0] for r in kept if r[3] == "validation"]
    expected += [r[0] for r in kept if r[3] == "test" and r[1:3] not in keys["validation"]]
    expected += [r[0] for r in kept if r[3] == "train" and r[1:3] not in keys["validation"] | keys["test"]]
    got = dedupe.leak_free_splits(table, KEYS, ["row_id"])
    assert sorted(r["row_id"] for r in got.collect()) == sorted(expected)


def test_split_dedupe_uses_group_limit(table):
    plan = dedupe.leak_free_splits(table, KEYS, ["row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_remove_leaks_matches_nulls_and_keeps_copies(table, rows):
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    seen = {r[1:3] for r in rows if r[3] == "test"}
    expected = sorted(r[0] for r in rows if r[3] == "train" and r[1:3] not in seen)
    assert sorted(r["row_id"] for r in dedupe.remove_leaks(train, test, KEYS).collect()) == expected


def test_digest_keeps_fields_apart(spark):
    pairs = [("a", "bc"), ("ab", "c"), (None, ""), ("", None), ("null", ""), ("1:a", ""), ("1", ":a")]
    df = spark.createDataFrame(pairs, "hi_en string, en string")
    assert df.select(dedupe.key_digest(*KEYS)).distinct().count() == len(pairs)


def test_row_index_is_dense_and_ordered(table, rows):
    got = indexing.row_index(table.select("row_id", "split", "hi_en"), ["hi_en", "row_id"], ["split"]).collect()
    for split in ("train", "validation", "test"):
        part = [(r["row_index"], r["hi_en"], r["row_id"]) for r in got if r["split"] == split]
        part.sort(key=lambda x: x[0])
        assert [p[0] for p in part] == list(range(len(part)))
        key = lambda x: (x[1] is not None, x[1] or "", x[2])
        assert part == sorted(part, key=key)


def test_row_index_survives_other_partitioning(spark, table):
    def index(df, n):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(tuple(r) for r in indexing.row_index(df.select("row_id"), ["row_id"]).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)

    assert index(table, "1") == index(table.repartition(3), "7") == [(i, i) for i in range(600)]


def test_batches_ranges_and_subsets(table):
    indexed = indexing.with_batches(indexing.row_index(table.select("row_id"), ["row_id"]))
    sizes = [r["count"] for r in indexed.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [32] * 18 + [24]
    assert indexing.first_rows(indexed).count() == 32
    assert [r[0] for r in indexing.row_range(table, 3, 6).select("row_id").orderBy("row_id").collect()] == [3, 4, 5, 6]
    assert indexing.row_range(table, None, 6).count() == 7
    ranges = indexing.label_ranges(table, [0, 100, 125]).groupBy("range_no").count().collect()
    assert {r[0]: r[1] for r in ranges} == {0: 100, 1: 25, 2: 475}


def test_seeded_shuffle(table):
    def order(seed):
        keys = indexing.loader_order("split", "row_id", seed)
        got = indexing.row_index(table.select("row_id", "split"), keys, ["split"]).collect()
        return {r["row_id"]: r["row_index"] for r in got if r["split"] == "train"}, sorted(
            (r["row_index"], r["row_id"]) for r in got if r["split"] == "test"
        )

    (one, test_one), (again, _), (other, test_other) = order(1), order(1), order(2)
    assert one == again != other
    assert test_one == test_other and [r for _, r in test_one] == sorted(r for _, r in test_one)


def test_enrich_counts_or_expands(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id long, en string")
    lookup = spark.createDataFrame([("a", "s"), ("a", "s"), ("a", "t"), ("c", "u")], "en string, source string")
    counted = joins.enrich(left, lookup, "en", ["source"]).select("row_id", "source", "copies").collect()
    assert {tuple(r) for r in counted} == {(1, "s", 2), (1, "t", 1), (2, None, 1), (3, None, 1)}
    expanded = joins.enrich(left, lookup, "en", ["source"], expand=True).select("row_id", "source").collect()
    assert Counter(tuple(r) for r in expanded) == Counter([(1, "s"), (1, "s"), (1, "t"), (2, None), (3, None)])


def test_pending_rows_can_resume(spark):
    df = spark.createDataFrame([(i, f"w{i} x") for i in range(6)], "row_id long, hi_en string")
    answered = spark.createDataFrame([(1,), (1,), (4,)], "row_id long")
    done = infer.translate_pending(df, answered, lambda: lambda ts: [t.upper() for t in ts], "hi_en")
    assert {r["row_id"]: r["translations"] for r in done.collect()} == {i: f"W{i} X" for i in (0, 2, 3, 5)}


def test_remote_translator_and_checks(spark):
    make = infer.remote_translator(lambda: lambda prompt, text: f"{len(prompt) > 0}:{text}", "Translate")
    assert infer.translate_text("film ka naam", make) == "True:film ka naam"
    df = spark.createDataFrame([("a",)], "hi_en string")
    assert infer.source_target(infer.translate(df, make, "hi_en"), "hi_en").first()[:] == ("a", "True:a")
    with pytest.raises(ValueError, match="en"):
        require_columns(df, "hi_en", "en")


def test_a_filter_does_not_call_the_translator_twice(spark, tmp_path):
    log = tmp_path / "calls"

    def make():
        def answer(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [t.upper() for t in texts]

        return answer

    df = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(10)], "row_id long, hi_en string").coalesce(1)
    got = infer.translate(df, make, "hi_en").where("length(translations) > 0").collect()
    assert sorted(r["translations"] for r in got) == [f"T{i}" for i in range(1, 10)]
    assert len(log.read_text().split()) == 9


def test_finished_slices_are_not_sent_again(spark, tmp_path):
    """A translator that dies half-way, then one that works: rows of finished slices are sent once."""
    calls, path = tmp_path / "calls", str(tmp_path / "log")
    rows = [(i, f"t{i}" if i % 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, hi_en string").repartition(3)

    def translator(dies: bool):
        def make():
            def answer(texts):
                if dies and "t33" in texts:
                    raise ConnectionError("gone")
                with open(calls, "a") as f:
                    f.writelines(f"{t}\n" for t in texts)
                return [t.upper() for t in texts]

            return answer

        return make

    with pytest.raises(Exception, match="gone"):
        infer.translate_slices(df, translator(True), "hi_en", path, 4)
    finished = {int(str(p.parent).split("slice-")[1].split("-")[0]) for p in (tmp_path / "log").glob("run=*/_SUCCESS")}
    at = {r["hi_en"]: r["k"] for r in df.select("hi_en", F.pmod(F.xxhash64(F.col("row_id").cast("string")), F.lit(4)).alias("k")).collect()}
    assert at["t33"] not in finished
    got = infer.translate_slices(df, translator(False), "hi_en", path, 4)
    assert sorted(map(tuple, got.collect())) == sorted((i, f"T{i}") for i, t in rows if t)
    before = Counter(calls.read_text().split())
    assert all(before[t] == 1 for _, t in rows if t and at[t] in finished)
    again = infer.translate_slices(df, translator(True), "hi_en", path, 4)
    assert again.count() == 54 and Counter(calls.read_text().split()) == before
    with pytest.raises(ValueError, match="another number"):
        infer.translate_slices(df, translator(False), "hi_en", path, 5)


def test_slices_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "row_id long, hi_en string")
    got = infer.translate_slices(df, lambda: lambda ts: ts, "hi_en", str(tmp_path / "log"), 2)
    assert got.columns == ["row_id", "line"] and got.count() == 0


def test_patient_translator(monkeypatch):
    slept, failures = [], [1, 1, 1]
    monkeypatch.setattr(infer.time, "sleep", slept.append)

    def make():
        if failures:
            failures.pop()
            raise ConnectionError("closed")
        return lambda texts: [t.upper() for t in texts]

    assert infer.patient_translator(make, attempts=4, wait=0.5)()(["a"]) == ["A"]
    assert slept == [0.5, 1.0, 2.0]
    failures[:] = [1] * 9
    with pytest.raises(ConnectionError):
        infer.patient_translator(make, attempts=2)()(["a"])
    failures.clear()
    slept.clear()
    monkeypatch.setattr(infer.time, "monotonic", lambda: 100.0)
    limited = infer.patient_translator(make, per_second=4)()
    assert limited(["a"]) == limited(["a"]) == ["A"] and slept == [0.0, 0.25]
    with pytest.raises(ValueError):
        infer.patient_translator(make, attempts=0)


def test_grouped_function_on_a_hot_group(table, rows):
    got = groups.apply_by_group(
        table.select("source", "row_id"),
        ["source"],
        lambda pdf: {"n": len(pdf), "total": int(pdf["row_id"].sum())},
        {"n": "long", "total": "long"},
        {"mean": F.col("total") / F.col("n")},
    )
    for r in got.collect():
        ids = [x[0] for x in rows if x[4] == r["source"]]
        assert r["mean"] == pytest.approx(sum(ids) / len(ids))
