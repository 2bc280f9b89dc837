"""Scores against hand-computed values and against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingweave.functions.ngrams import clipped_matches, match_counts, text_counts
from lingweave.functions.tokens import tokenize_13a
from lingweave.operators import embedding, metrics as M
from lingweave.operators.embedding import embedding_prf_by_join, with_embedding_prf


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, source string, hyp string, ref string")


def grams(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def counts(pairs, split, order):
    out = []
    for n in range(1, order + 1):
        m = h = r = 0
        for hyp, ref in pairs:
            a, b = grams(split(hyp), n), grams(split(ref), n)
            m += sum((a & b).values())
            h += sum(a.values())
            r += sum(b.values())
        out.append((m, h, r))
    return out


def words_13a(t):
    t = t.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    t = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {t} ")
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def bleu(pairs):
    stats = counts(pairs, words_13a, 4)
    if not any(m for m, _, _ in stats) or any(h == 0 for _, h, _ in stats):
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, h, _ in stats:
        if m == 0:
            smooth *= 2
        logs += math.log(100.0 * m / h if m else 100.0 / (smooth * h))
    _, hyp_len, ref_len = stats[0]
    return min(1.0, math.exp(1 - ref_len / hyp_len)) * math.exp(logs / 4)


def chrf(pairs):
    stats = [s for s in counts(pairs, lambda t: "".join(t.split()), 6) if s[1] and s[2]]
    if not stats:
        return 0.0
    p, r = (sum(m / s[k] for s in stats for m in [s[0]]) / len(stats) for k in (1, 2))
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def score(df):
    return df.first()["score"]


def test_known_values(spark):
    one = frame(spark, [("s", "the cat is on the mat", "the cat sat on the mat")])
    assert score(M.bleu(one, "hyp", "ref")) == pytest.approx(37.991784282579856)
    # 1-4-gram precisions 5/6, 3/5, 1/4, 0/3: one empty order makes the plain score 0
    assert score(M.plain_bleu(one, "hyp", "ref")) == 0.0
    same = frame(spark, [("s", "a b c d e", "a b c d e")])
    assert score(M.bleu(same, "hyp", "ref")) == pytest.approx(100)
    assert score(M.plain_bleu(same, "hyp", "ref")) == pytest.approx(1)
    assert score(M.chrf(same, "hyp", "ref")) == pytest.approx(100)
    short = frame(spark, [("s", "a b c d", "a b c d e f")])
    assert score(M.bleu(short, "hyp", "ref")) == pytest.approx(100 * math.exp(1 - 6 / 4))
    assert score(M.plain_bleu(short, "hyp", "ref")) == pytest.approx(math.exp(1 - 6 / 4))
    # "abc" and "abd": order 1 2/3, order 2 1/2, order 3 0
    letters = frame(spark, [("s", "a bc", "ab d")])
    assert score(M.chrf(letters, "hyp", "ref")) == pytest.approx(100 * (2 / 3 + 1 / 2) / 3)


@pytest.mark.parametrize("hyp, ref", [("", "a b"), ("a b", ""), ("", ""), ("x y z w", "a b c d"), (None, "a b")])
def test_empty_and_disjoint(spark, hyp, ref):
    df = frame(spark, [("s", hyp, ref)])
    assert score(M.bleu(df, "hyp", "ref")) == 0
    assert score(M.plain_bleu(df, "hyp", "ref")) == 0
    assert score(M.chrf(df, "hyp", "ref")) == 0


ALPHABET = ["the", "cat", "a.b", "1,000", "3-4", "it's", "&amp;", "x-\n", "(y)", "é", "中", "...", "<skipped>", "U.S.", "\n"]


def random_pairs(seed, n):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12)))
    out = []
    for _ in range(n):
        ref = text()
        hyp = " ".join(w for w in ref.split(" ") if rnd.random() > 0.3) if rnd.random() < 0.8 else text()
        out.append((rnd.choice(["hot", "hot", "s1", "s2"]), hyp, ref))
    return out


def test_13a_tokens(spark):
    rows = [(h,) for _, h, _ in random_pairs(3, 300)]
    got = spark.createDataFrame(rows, "t string").select("t", tokenize_13a(F.col("t"))).collect()
    assert all(b.split() == words_13a(a) for a, b in got)


def test_scores_equal_brute_force(spark):
    rows = random_pairs(1, 800)
    df = frame(spark, rows).repartition(5)
    by = {s: [(h, r) for x, h, r in rows if x == s] for s in ("hot", "s1", "s2")}
    got = {r["source"]: r["score"] for r in M.bleu(df, "hyp", "ref", "source").collect()}
    assert got == {s: pytest.approx(bleu(p)) for s, p in by.items()}
    got = {r["source"]: r["score"] for r in M.chrf(df, "hyp", "ref", "source").collect()}
    # a row without reference grams of an order gives no hypothesis grams for it
    full = {s: [(h, r) for h, r in p if len("".join(r.split())) >= 6] for s, p in by.items()}
    kept = df.where(F.length(F.regexp_replace("ref", r"\s", "")) >= 6)
    got_full = {r["source"]: r["score"] for r in M.chrf(kept, "hyp", "ref", "source").collect()}
    assert got_full == {s: pytest.approx(chrf(p)) for s, p in full.items()}
    assert set(got) == set(by)


def test_counts_do_not_depend_on_chunks():
    pairs = [(h, r) for _, h, r in random_pairs(9, 60)]
    together = match_counts([h for h, _ in pairs], [r for _, r in pairs], 4, True)
    alone = np.concatenate([match_counts([h], [r], 4, True) for h, r in pairs])
    assert (together == alone).all()


def test_batch_mean_differs_from_corpus_score(spark):
    rows = random_pairs(5, 96)
    df = frame(spark, rows).withColumn("batch_id", F.floor(F.col("row_id") / 32))
    stats = M.with_bleu_stats(df, "hyp", "ref")
    mean = M.batch_mean_bleu(stats, ["batch_id"]).first()["score"]
    batches = [[(h, r) for _, h, r in rows[i : i + 32]] for i in (0, 32, 64)]
    assert mean == pytest.approx(sum(map(bleu, batches)) / 3)
    assert mean != pytest.approx(bleu([(h, r) for _, h, r in rows]))


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<double>")


def test_embedding_match(spark, vectors):
    rnd = random.Random(2)
    ids = lambda: [rnd.randrange(20) for _ in range(rnd.randint(1, 15))]
    rows = [(i, ids(), ids()) for i in range(40)]
    blank = [(40, [], [1]), (41, [], [])]
    df = spark.createDataFrame(rows + blank, "row_id long, hyp array<int>, ref array<int>")
    table = {r["vec_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    cos = lambda a, b: table[a] @ table[b] / np.linalg.norm(table[a]) / np.linalg.norm(table[b])
    sent, joined = (
        with_embedding_prf(df, "hyp", "ref", vectors, limit).drop("hyp", "ref").orderBy("row_id").collect()
        for limit in (1 << 20, 0)
    )
    assert len(sent) == len(joined) == len(rows) + 2
    assert all(tuple(r)[1:] == (0, 0, 0) for r in [*sent[40:], *joined[40:]])
    for r, j, (_, hyp, ref) in zip(sent, joined, rows):
        p = np.mean([max(cos(h, x) for x in ref) for h in hyp])
        q = np.mean([max(cos(h, x) for h in hyp) for x in ref])
        expected = pytest.approx((p, q, 2 * p * q / (p + q)))
        assert tuple(r)[1:] == expected and tuple(j)[1:] == expected


def test_sparse_and_unknown_vector_ids(spark):
    rnd = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in (700, 10, 11, 305)], "vec_id long, embedding array<float>")
    rows = [(1, [10, 11, 9], [305]), (1, [700], [700, 1]), (2, [9], [10]), (2, [9], [10]), (3, [], [5])]
    df = spark.createDataFrame(rows, "row_id long, hyp array<int>, ref array<int>")
    sent, joined = (sorted(map(str, with_embedding_prf(df, "hyp", "ref", vectors, limit).collect())) for limit in (1 << 20, 0))
    assert len(sent) == len(rows)
    fix = lambda rows: [re.sub(r"(\d\.\d{9})\d+", r"\1", r) for r in rows]
    assert fix(sent) == fix(joined)


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_rows_in_tiles_equal_whole_rows(spark, vectors, tile):
    rnd = random.Random(8)
    rows = [(i, [rnd.randrange(25) for _ in range(rnd.randint(0, 40))], [rnd.randrange(25) for _ in range(rnd.randint(0, 4))]) for i in range(30)]
    df = spark.createDataFrame([*rows, rows[0], (31, None, [1]), (None, [3], [3])], "row_id long, hyp array<int>, ref array<int>")
    df = df.select("row_id", F.coalesce("hyp", F.array().cast("array<int>")).alias("hyp"), "ref")
    sent, tiled = (
        sorted([tuple(str(x) for x in r[:3]), r[3:]] for r in with_embedding_prf(df, "hyp", "ref", vectors, limit, tile).collect()) for limit in (1 << 20, 0)
    )
    assert len(sent) == len(tiled) == 33
    for (key, whole), (other, parts) in zip(sent, tiled):
        assert key == other and parts == pytest.approx(whole)


def test_a_long_row_never_stands_in_one_group(spark):
    n, tile = 6000, 500
    rnd = np.random.default_rng(6)
    table = rnd.normal(size=(n, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    df = spark.createDataFrame([(1, list(range(n)), list(range(0, n, 2))), (2, [1, 1, 2], [2])], "row_id long, hyp array<int>, ref array<int>")
    sent, tiled = ({r["row_id"]: r[3:] for r in with_embedding_prf(df, "hyp", "ref", vectors, limit, tile).collect()} for limit in (1 << 30, 0))
    assert {k: pytest.approx(v) for k, v in sent.items()} == tiled
    scored = embedding_prf_by_join(df, "row_id", "hyp", "ref", vectors, tile)
    groups = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "hyp_tile" in groups and "ref_tile" in groups


def test_systems_equal_single_scores(spark):
    rows = random_pairs(5, 40)
    df = frame(spark, rows).withColumn("same", F.col("ref"))
    got = {(r["system"], r["source"]): (r["bleu"], r["chrf"]) for r in M.compare_systems(df, ["hyp", "same"], "ref").collect()}
    for system in ("hyp", "same"):
        bleu = {r["source"]: r["score"] for r in M.bleu(df, system, "ref", "source").collect()}
        chrf = {r["source"]: r["score"] for r in M.chrf(df, system, "ref", "source").collect()}
        assert {k[1]: v for k, v in got.items() if k[0] == system} == {s: pytest.approx((bleu[s], chrf[s])) for s in bleu}
    with pytest.raises(ValueError, match="missing columns"):
        M.compare_systems(df, ["nope"], "ref")


def test_report_has_groups_and_overall(spark, vectors):
    rows = random_pairs(11, 60)
    df = frame(spark, rows).withColumn("forced", F.col("ref"))
    one = F.array(F.lit(1))
    df = df.withColumn("hyp_ids", one).withColumn("ref_ids", one)
    got = {r["source"]: r for r in M.report(df, "forced", "hyp", "ref", "hyp_ids", "ref_ids", vectors).collect()}
    assert set(got) == {"hot", "s1", "s2", None}
    assert got[None]["bleu"] == pytest.approx(100) and got[None]["f1"] == pytest.approx(1)


def test_shared_ids_are_not_compared(spark, monkeypatch):
    """An id on both sides matches itself; zero vectors and texts without a shared id score as before."""
    rng = np.random.default_rng(5)
    table = rng.normal(size=(40, 8))
    table[7] = 0
    pairs = [(rng.integers(0, 40, n), rng.integers(0, 40, m)) for n, m in ((30, 50), (1, 9), (20, 20))] + [(np.arange(40), np.arange(40)), (np.array([7]), np.array([7, 7, 3])), (np.arange(5), np.arange(9, 20))]
    seen = []

    def counted(a, b, best=embedding._best):
        seen.append(len(a) * len(b))
        return best(a, b)

    monkeypatch.setattr(embedding, "_best", counted)
    got = [embedding._score(h, r, table) for h, r in pairs]
    unit = embedding._unit(table)
    for (h, r), (p, q, _) in zip(pairs, got):
        cosine = unit[h] @ unit[r].T
        assert (p, q) == (pytest.approx(cosine.max(axis=1).mean()), pytest.approx(cosine.max(axis=0).mean()))
    seen.clear()
    embedding._score(np.arange(40), np.arange(39), table)
    assert sum(seen) == 39


def test_scores_take_texts_in_batches_of_some_megabytes(spark):
    sizes = F.arrow_udf(_batch_bytes, "long")
    rows = spark.range(0, 1500, 1, 1).select(F.lit("s").alias("source"), F.repeat(F.lit("some text "), 1000).alias("hyp"), F.repeat(F.lit("some "), 2000).alias("ref"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert M.plain_bleu(rows, "hyp", "ref", "source").count() == 1
    assert rows.agg(F.max(sizes("hyp"))).first()[0] < 6_000_000


def _batch_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([batch.nbytes] * len(batch), pa.int64())


def flat(pairs, split, order):
    return [x for m in counts(pairs, split, order) for x in m]


def expected_counts(columns):
    ref, *hyps = columns
    bare = lambda t: "".join(t.split())
    return [[flat([p], words_13a, 4) + flat([p], bare, 6) for p in zip(hyp, ref)] for hyp in hyps]


@pytest.mark.parametrize("alphabet", ["a1.,- ", "ab1 .,-/&;<>$\n\té😀", ["a", "<skipped>", "-\n", "&amp;", "&lt;", "quot;", "&", " ", "1", ".", "-"], [chr(c) for c in range(0x4E00, 0x5A00)]])
def test_counts_of_all_hypotheses_equal_brute_force(alphabet):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
    ref = ["", "a", "1..5", "a..5", "1...5,", "2-3--4", "\u3000", *(text() for _ in range(150))]
    hyps = [["".join(c for c in t if rnd.random() > 0.1) for t in ref], [text() for _ in ref], ref]
    assert text_counts([ref, *hyps], (4, 6)).tolist() == expected_counts([ref, *hyps])


@pytest.mark.parametrize("sides, rows, size, letters, order", [(2, 3, 400, 2, 6), (3, 300, 40, 30_000, 4), (2, 1, 3000, 1 << 31, 3), (5, 2, 5000, 3, 2)])
def test_matches_of_many_units_and_long_texts(sides, rows, size, letters, order):
    """Units too many for one number, and texts too long for counts of all sides in one."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(0, size, sides * rows)
    sizes[0] = size
    codes = np.concatenate([rng.integers(0, min(letters, 200), n) * (letters // min(letters, 200)) for n in sizes])
    texts = np.split(codes, np.cumsum(sizes)[:-1])
    got = clipped_matches(codes, sizes, sides, order)
    for side in range(1, sides):
        for row in range(rows):
            a, b = texts[side * rows + row].tolist(), texts[row].tolist()
            assert got[side - 1, row].tolist() == [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, order + 1)]


def test_systems_are_compared_in_one_step(spark):
    """The reference goes to Python once for all systems, and its words are cut there instead of by regexes."""
    df = frame(spark, random_pairs(6, 30)).withColumn("same", F.col("ref"))
    plan = M.compare_systems(df, ["hyp", "same"], "ref")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython [^\n]*", plan.partition("Initial Plan")[0])) == 1 and "regexp_replace" not in plan


def test_broken_and_missing_texts_are_compared(spark):
    texts = ["X'6162FF20632064'", "X'C3A9'", "NULL", "X''"]
    df = spark.sql(" UNION ALL ".join(f"SELECT 's' AS source, CAST({t} AS STRING) AS ref" for t in texts)).withColumn("none", F.lit(None).cast("string"))
    got = {r["system"]: r["chrf"] for r in M.compare_systems(df, ["ref", "none"], "ref").collect()}
    assert got == {"ref": pytest.approx(100), "none": 0}
