"""Language identification and quality rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingweave.llm import features, language, quality
from tests.llm import brute


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).where(language.held_out(F.col("doc_id")))
    right, n, low, high = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right / n > 0.98 and 0 < low and high < 1


def test_language_edge_cases(edge, nothing):
    rows = language.identify(edge).collect()
    assert len(rows) == edge.count()
    by_text = {r.text: (r.lang_pred, r.score) for r in rows}
    for text in (None, "", " \t\n \r\n ", "12345 %% 67"):
        assert by_text[text] == ("und", 0.0)
    assert by_text["x"][0] in ("en", "de", "es")
    assert language.identify(nothing).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_learns_only_from_its_part(spark):
    texts = {"aa": "mala kala tala", "bb": "zyx vyx wyx"}
    rows = [(i, texts["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    lying = docs.withColumn("lang", F.when(held, "cc").otherwise(F.col("lang")))
    assert {(r.lang_pred, r.text) for r in language.identify(lying).collect()} == {(k, v) for k, v in texts.items()}


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([c, 5 + rng.integers(40)]), np.array([0.8, 0.6]), c) for c in rng.integers(0, 3, 400)]
    w, b = language.fit_ftrl(rows, 3, 64)
    assert all((x @ w[at] + b).argmax() == c for at, x, c in rows)
    assert (w == 0).mean() > 0.3


def test_base_counts(spark, edge, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    for r in quality.judge(docs, None).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.base_counts(r.text)
        assert r.kept == (not r.base_failed) and r.low_quality is None


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.rate(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), labels).join(labels, "doc_id").collect()
    wrong = [r for r in rows if not r.base_failed and r.kept != bool(r.quality)]
    assert len(wrong) <= 0.02 * len(rows)
    assert all(0 <= r.low_quality <= 1 for r in rows)


def test_quality_edge_cases(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 0), (1, 1), (1, 0), (7, 1), (99, 0)], "doc_id long, quality int")
    for labels in (none, odd, odd.where("quality = 1")):
        rows = quality.rate(edge, labels).collect()
        assert len(rows) == edge.count()
        assert not any(r.kept for r in rows if r.text in (None, "", "x"))
    assert quality.rate(nothing, odd).count() == 0


def test_calibration_and_sample(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * z + 1)))).astype(float)
    slope, shift = quality.fit_calibration(z, y)
    assert abs(slope - 3) < 0.4 and abs(shift - 1) < 0.2
    assert quality.fit_calibration(z, np.ones(4000)) == (1.0, 0.0)
    ids = spark.range(10_000).withColumnRenamed("id", "key")
    first = features.sample(ids, "key", 500, "s")
    assert 400 < first.count() < 600
    assert set(first.collect()) == set(features.sample(ids.repartition(7), "key", 500, "s").collect())
    assert features.sample(ids, "key", 20_000, "s").count() == 10_000


def test_temperature():
    labels = np.array([0, 1] * 50)
    logits = np.eye(2)[labels] * 50
    assert 0.02 < language.fit_temperature(logits, labels) < 20
    assert language.fit_temperature(np.zeros((0, 2)), np.zeros(0, np.int64)) == 1.0
    p = features.softmax(logits / language.fit_temperature(logits, labels)).max(1)
    assert (p < 1).all() and p.mean() == pytest.approx(101 / 102, abs=0.01)
