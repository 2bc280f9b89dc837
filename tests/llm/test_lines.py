"""Line dedup against plain Python, and the perfect hash by itself."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingweave.llm import lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least_chars=20, least_docs=3):
    """``(n_lines, n_dropped, text)`` of every row."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if key(x) not in last or last[key(x)] == i]
        out.append((i, len(own), len(own) - len(left), "\n".join(left)))
    return out


def compare(spark, rows, **given):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lines.drop_lines(docs, **given).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert Counter(map(tuple, found)) == Counter(plain(rows))


def test_fixture(spark, edge):
    docs = edge.unionByName(edge.withColumn("doc_id", F.col("doc_id") + 10)).unionByName(edge.withColumn("doc_id", F.col("doc_id") - 3))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = lines.drop_lines(docs)
    assert found.columns == ["doc_id", "lang", "n_words", "score", "a.b", "n_lines", "n_dropped", "text"]
    assert Counter(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "text").collect())) == Counter(plain(rows))


@pytest.mark.parametrize("shard_keys", [3, 100_000])
def test_borders_of_lines(spark, shard_keys):
    shared, other = "This LINE is long enough to count ñ", "twenty code points ñ"
    rows = [
        (1, f"{shared}\nown\n\n  {shared.upper().replace('Ñ', 'ñ')}\t\r\n"),
        (2, f"\n\n{shared}"),
        (3, shared),
        (3, f"x\n{shared}\n{shared}\n"),
        (None, f"{shared}\n{other}\n"),
        (None, f"{other}\nonly null ids hold the other line"),
        (None, other),
        (4, "short\n" * 5),
        (5, "short"),
        (6, "\n".join(f"a line of its own, number {i % 40}" for i in range(400))),
        (7, "\n".join(f"a line of its own, number {i}" for i in range(40))),
        (8, "\n".join(f"A line of its own, number {i}  " for i in range(39, -1, -1))),
        (9, " \n" * 1000),
        (10, None),
        (11, ""),
    ]
    compare(spark, rows, shard_keys=shard_keys)


def test_empty(spark, nothing):
    assert lines.drop_lines(nothing).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 64, (2, 50_000), dtype=np.uint64)
    high[:1000] = high[0]  # keys that share half of their bits
    shard = lines.Shard.load(lines.Shard.build(high, low, np.arange(50_000), np.arange(50_000), np.zeros(50_000, bool)).save())
    at = shard.find(high, low)
    assert np.array_equal(np.sort(at), np.arange(50_000))
    assert np.array_equal(shard.last[at], np.arange(50_000))
    assert 8 * shard.words.nbytes < 5 * 50_000
    assert (shard.find(*rng.integers(0, 1 << 64, (2, 50_000), dtype=np.uint64)) == -1).all()


def test_shards_are_dropped_from_memory(spark):
    rng = np.random.default_rng(2)
    high, low = rng.integers(-(1 << 63), 1 << 63, (2, 1000))
    counts = spark.createDataFrame([(int(h), int(v), 3, i) for i, (h, v) in enumerate(zip(high, low))], "high long, low long, n long, last long")
    folder = lines.shared_folder(spark, "test-index")
    shards = lines.build_index(counts, folder, 100)
    assert shards == 10
    for kept in (0, 1 << 20):
        index = lines.Index(folder, shards, kept)
        known, last, null = index.last(high.view(np.uint64), low.view(np.uint64))
        assert known.all() and not null.any() and np.array_equal(last, np.arange(1000))
        assert (len(index._open) == 1) == (kept == 0)
