"""Contamination against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lingweave.llm import decontaminate as dc
from tests.llm import brute


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 13, 14, 20]))) for i in range(2, 14)] + [(None, text(15)), (20, None), (21, ""), (5, text(13))]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(30)]
    docs += [(100 + i, f"{text(5)} {item}, {text(4)}") for i, (_, item) in enumerate(items) if item] * 2
    docs += [(200, None), (None, items[0][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_hits_equal_search(spark, planted, block_bytes):
    docs, items = planted
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = dc.judge(d, i, block_bytes=block_bytes).collect()
    expected = []
    for doc_id, text in docs:
        n, hit, ids = brute.contamination(text, items)
        expected.append((doc_id, n, hit, ids, hit > 0 and 20 * hit >= n))
    shown = lambda rows: sorted(map(repr, rows))
    assert shown((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in got) == shown(expected)
    for r in got:
        assert r.n_hit == sum(h.n_words for h in r.hits)
        assert all(a.word + a.n_words < b.word for a, b in zip(r.hits, r.hits[1:]))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for size, base, depth in ((0, 3, 5), (1, 2, 5), (300, 2, 40), (300, 5, 13), (200, 1, 64)):
        ids = rng.integers(1, base + 1, size)  # 0 ends documents and stands for the end of the row
        order = dc.suffix_array(ids, depth)
        assert sorted(order) == list(range(size))
        prefixes = [list(ids[i : i + depth]) for i in order]
        assert prefixes == sorted(prefixes)


def test_longest_matches(spark, planted):
    docs, items = planted
    items = items[:6]
    d = spark.createDataFrame(docs, "doc_id long, text string").where("doc_id is not null").repartition(3)
    got = {(r.item_id, r.item_word): r for r in dc.longest_matches(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = [(i, brute.alnum_words(t)) for i, t in docs if i is not None]
    for item_id, item in items:
        w = brute.alnum_words(item)
        for at in range(len(w)):
            best = max((n for _, o in own for j in range(len(o)) for n in [_common(w[at:], o[j:])]), default=0)
            r = got.get((item_id, at))
            assert (r.n_words if r else 0) == best
            if r:
                assert any(i == r.doc_id and o[r.doc_word : r.doc_word + best] == w[at : at + best] for i, o in own)


def _common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_edge_cases(spark, edge, nothing):
    items = spark.createDataFrame([(1, "seven eight nine"), (2, "w3 and3"), (3, None)], "item_id long, text string")
    rows = dc.judge(edge, items).collect()
    assert len(rows) == edge.count() and set(edge.columns) <= set(rows[0].asDict())
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows if r.doc_id in (3, 4, None)} == {3: (0, 0, []), 4: (0, 0, []), None: (12, 3, [1])}
    assert next(r for r in rows if r.doc_id == 7 and r.n_words > 1).item_ids == [2]
    assert dc.judge(nothing, items).count() == 0
    assert not any(r.contaminated for r in dc.judge(edge, items.where("false")).collect())
    assert dc.decontaminate(edge, items).columns == edge.columns
