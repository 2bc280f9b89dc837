"""Near copies against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lingweave.llm import near
from tests.llm import brute


@pytest.fixture(scope="module")
def planted(spark, sf):
    rng = random.Random(9)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = [f"t{rng.randrange(400)}" for _ in range(120)]
    for i in range(150):  # a group whose members are near some others and not all
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
        docs[10_000 + i] = " ".join(copy)
    for i in range(60):  # small sets around the threshold
        n = rng.randrange(1, 12)
        docs[20_000 + i] = " ".join(f"s{j}" for j in range(n))
    for i in range(20):
        docs[30_000 + i] = docs[0]
    docs |= {40_000: None, 40_001: "", 40_002: " \n", 40_003: "a b", 40_004: "A  b", 40_005: "b a"}
    return docs


@pytest.mark.parametrize("limit", [near.GROUP_SHINGLES, 1500])
def test_components_equal_brute_force(spark, planted, limit):
    frame = spark.createDataFrame(list(planted.items()), "doc_id long, text string").repartition(4)
    rows = near.near_duplicates(frame, group_shingles=limit).collect()
    expected = brute.near_components(planted)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(brute.shingles(t)), expected[i], expected[i] == i) for i, t in planted.items()
    }


def test_keep_one_with_stage_settings(spark, planted):
    frame = spark.createDataFrame([(i, t, "x") for i, t in planted.items()], "doc_id long, text string, lang string")
    got = near.keep_one(frame.unionByName(frame.where("doc_id < 20")), shingle=5, similarity=80)
    expected = brute.near_components(planted, 5, 80)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in expected.items() if i == c)
    assert got.columns == frame.columns


def test_edge_cases(edge, nothing):
    rows = near.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id == 1] == [(1, True)] * 2
    assert next((r.component_id, r.kept) for r in rows if r.doc_id is None) == (None, True)
    assert {r.n_shingles for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert near.near_duplicates(nothing).count() == 0
    assert near.keep_one(nothing).count() == 0


def test_rows_with_null_or_repeated_ids(spark):
    words = [f"n{i}" for i in range(100)]
    near_copy = lambda i: " ".join([*words, f"end{i}"])
    other = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(None, near_copy(i)) for i in range(5)]  # no member has an id
    rows += [(None, other("x")), (1, other("x") + " more")]  # the null id loses its group
    rows += [(2, other("y")), (2, other("z") + " more"), (1, other("z"))]  # id 2 is kept once and loses once
    rows += [(3, other("u")), (3, other("u") + " more")]  # one id, two near texts
    rows += [(4, None), (4, None), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [tuple(r) for r in near.keep_one(frame).collect()]
    assert len([r for r in kept if r[0] is None and r[1]]) == 1
    assert sorted(r for r in kept if r[0] in (1, 2)) == [(1, other("x") + " more"), (1, other("z")), (2, other("y"))]
    assert len([r for r in kept if r[0] == 3]) == 1
    assert sorted((r for r in kept if not r[1]), key=repr) == [(4, None), (None, ""), (None, None)]
    flags = near.near_duplicates(frame).where("n_shingles > 0").collect()
    assert sorted((r.doc_id for r in flags if r.kept), key=str) == [1, 1, 2, 3, 3, None]
    assert all(r.kept == (r.doc_id == r.component_id) for r in flags if r.doc_id is not None)


def test_search_reads_one_text_of_a_class(spark, monkeypatch):
    groups = [" ".join(f"g{g}w{j}" for j in range(40)) for g in range(6)]
    rows = [(None, t + end) for t in groups for end in ("", " a")] * 20
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    search, read = near._search, spark.sparkContext.accumulator(0)

    def counted(*settings):
        run = search(*settings)

        def counting(table):
            read.add(table.num_rows)
            return run(table)

        return counting

    monkeypatch.setattr(near, "_search", counted)
    assert near.keep_one(frame).count() == 6
    assert read.value == 12  # classes, however many rows share the null id


def test_components_of_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "node long, centre long")
    got = {r.node: r.label for r in near.components(frame).collect()}
    expected = brute.roots(341, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: expected[x] for x in touched}


def test_stars_link_a_bucket_that_spans_tasks(spark):
    entries = [(1, i) for i in range(2000)] + [(2, 5000), (2, 5001), (3, 7000)]
    edges = [tuple(r) for r in near.stars(spark.createDataFrame(entries, "bucket long, node long").repartition(5)).collect()]
    assert len(edges) <= len(entries)
    expected = brute.roots(7001, edges)
    assert {expected[i] for i in range(2000)} == {0}
    assert expected[5001] == 5000 and expected[7000] == 7000


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    common, own = rng.integers(0, 1 << 63, 800, np.uint64), rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.sort(common), np.sort(np.concatenate([common, own]))]
    bounds = np.array([0, 800, 1800])
    bins = near.BANDS * near.ROWS
    table = near.one_permutation(np.concatenate(sets), bounds, bins, near.walk_table(bins))
    assert (table[0] == table[1]).mean() == pytest.approx(0.8, abs=0.12)
    few = near.one_permutation(np.array([7], np.uint64) << np.uint64(50), np.array([0, 1]), bins, near.walk_table(bins))
    assert (few == few[0, 0]).all()
