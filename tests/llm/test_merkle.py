"""The manifest against a tree built in plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lingweave.llm import merkle
from tests.llm.brute import sha256

FIELDS = ["doc_id", "lang", "text"]


def leaf_of(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, fan_out):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha256("".join(last[i : i + fan_out])) for i in range(0, len(last), fan_out)])
    return levels


def steps_of(levels, at, fan_out):
    out = []
    for level in levels[:-1]:
        first = at - at % fan_out
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fan_out])))
        at //= fan_out
    return out


def expected(rows, fan_out):
    """``(leaf, subroot, root, steps)`` of every row."""
    parts = defaultdict(list)
    for r in rows:
        parts["0" if r[1] is None else "1" + r[1]].append(((r[0] is not None, r[0] or 0), leaf_of(r)))
    trees = {p: levels_of([leaf for _, leaf in sorted(v)], fan_out) for p, v in parts.items()}
    names = sorted(trees, key=str.encode)
    top = levels_of([trees[p][-1][0] for p in names], fan_out)
    return [
        (leaf, trees[p][-1][0], top[-1][0], tuple(steps_of(trees[p], i, fan_out) + steps_of(top, names.index(p), fan_out)))
        for p in names
        for i, leaf in enumerate(trees[p][0])
    ]


@pytest.mark.parametrize("fan_out, digits", [(2, 1), (3, 1), (2, 10)])
def test_proofs(spark, edge, fan_out, digits):
    many = edge.unionByName(edge.withColumn("doc_id", F.col("doc_id") + 10)).unionByName(edge.withColumn("lang", F.lit("en")))
    rows = [tuple(r) for r in many.select(*FIELDS).collect()]
    manifest = merkle.build(many, "lang", ["doc_id"], merkle.leaf_digest([F.col(c) for c in FIELDS]), {"doc_id": F.col("doc_id")}, fan_out, digits)
    found = merkle.proofs(manifest)
    shown = found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("digest", merkle.path_digest(F.col("path"))).collect()
    got = Counter((r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in shown)
    assert got == Counter(expected(rows, fan_out))
    assert all(r.folded == r.root for r in shown)
    assert all(r.digest == sha256("".join(s.before + s.after for s in r.path)) for r in shown)
    assert Counter(r.doc_id for r in shown) == Counter(r[0] for r in rows)


def test_some_leaves_only(spark, edge):
    manifest = merkle.build(edge, "lang", ["doc_id"], merkle.leaf_digest([F.col(c) for c in FIELDS]), digits=1)
    wanted = spark.createDataFrame([("1en", 1), ("1en", 1), ("1de", 0), ("1none", 5)], "_of string, _rank long")
    found = merkle.proofs(manifest, wanted)
    every = {(r._of, r._rank): r for r in merkle.proofs(manifest).collect()}
    got = {(r._of, r._rank): r for r in found.collect()}
    assert got == {k: every[k] for k in [("1en", 1), ("1de", 0)]} and found.count() == 2


def test_equal_subtrees_have_one_record(spark):
    same = spark.range(64).select(F.lit(1).alias("doc_id"), F.lit("en").alias("lang"), F.lit("x").alias("text"))
    manifest = merkle.build(same, "lang", ["doc_id"], merkle.leaf_digest([F.col(c) for c in FIELDS]), digits=2)
    assert [r.select("_digest").distinct().count() for r in manifest.rounds] == [1, 1, 1]
    rows = merkle.proofs(manifest).select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root").collect()
    assert len(rows) == 64 and all(r.f == r.root for r in rows)


def test_empty(spark, nothing):
    manifest = merkle.build(nothing, "lang", ["doc_id"], merkle.leaf_digest([F.col(c) for c in FIELDS]))
    assert manifest.root().count() == 0 and merkle.proofs(manifest).count() == 0


def test_arguments(nothing):
    with pytest.raises(ValueError):
        merkle.build(nothing, "lang", ["doc_id"], F.lit(""), fan_out=1)
