"""Segmentation and likelihood over lattices."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingweave.llm import lattice, lm, pieces
from tests.llm import brute

TEXTS, SCORES, KINDS = lattice.load_pieces(pieces.VOCABULARY)
TABLE = {t: (i, s) for i, (t, s, k) in enumerate(zip(TEXTS, SCORES, KINDS)) if k == "piece"}

UNKNOWN = min(s for _, s in TABLE.values()) - pieces.UNKNOWN_PENALTY


def best(text: str) -> list[int]:
    """Plain Viterbi over a whole text."""
    if not text:
        return []
    s = lattice.MARK + text.translate({0x20: lattice.MARK, ord(lattice.MARK): "\0"})
    score, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 16), e):
            found = TABLE.get(s[b:e]) or ((-1, UNKNOWN) if e - b == 1 else None)
            if found and score[b] + found[1] > score[e]:
                score[e], back[e] = score[b] + found[1], (b, found[0])
    out, at = [], len(s)
    while at:
        b, i = back[at]
        out.append([i] if i >= 0 else [x + KINDS.index("byte") for x in s[b:at].replace("\0", lattice.MARK if lattice.MARK in text else "\0").encode()])
        at = b
    return [i for part in reversed(out) for i in part]


def test_encode_equals_viterbi_and_round_trips(spark, edge, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    docs = docs.unionByName(edge.select("doc_id", "text"))
    first_byte = KINDS.index("byte")

    def score(ids: list[int]) -> float:
        """A character without a piece counts once, at its first byte."""
        lead = [i for i in ids if KINDS[i] == "byte" and not 0x80 <= i - first_byte < 0xC0]
        return sum(SCORES[i] for i in ids if KINDS[i] == "piece") + len(lead) * UNKNOWN

    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert r.decoded == text
        if len(text) < 3000:
            assert score(r.ids) == pytest.approx(score(best(text)))


def test_long_and_odd_units(spark, nothing):
    texts = ["ab" * 700, "a;\r\nb {\r", "   three   ", " ", "      ","  lead", "trail  ", "a\tb\r\nc", "\u0000x", "\u2581", "a\u2581b \u2581\u2581 \uffff", "👅👅", "x" * 300 + " " + "y" * 40]
    rows = pieces.decode(pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        assert r.decoded == r.text
        if len(r.text) < 300:
            assert sum(SCORES[i] for i in r.ids) == pytest.approx(sum(SCORES[i] for i in best(r.text)))
    assert len(rows) == len(texts)
    assert pieces.encode(nothing).count() == 0


def test_a_task_sorts_the_edges_of_one_owner(spark, monkeypatch):
    held, segment = [], pieces.segment

    def counted(units, *args):
        held.extend(r["n"] for r in units.groupBy(F.spark_partition_id()).agg(F.countDistinct("owner").alias("n")).collect())
        return segment(units, *args)

    monkeypatch.setattr(pieces, "segment", counted)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    rows = pieces.encode(docs, decoded="decoded").collect()
    assert len(held) > 8 and set(held) == {1}
    assert len(rows) == 40 and all(r.decoded == r.text for r in rows)


def test_hash_ranges_grow_before_the_first_gigabyte(edge, monkeypatch):
    sizes = (1 << 20, 200 << 20, 6 << 30)
    found = []
    for size in sizes:
        monkeypatch.setattr(pieces, "input_bytes", lambda df: size)
        monkeypatch.setattr(pieces.X, "input_bytes", lambda df: size)
        found.append(pieces.ranges(edge))
    assert found == [64, 200, 1536]


def test_encode_replaces_clashing_columns(edge):
    got = pieces.encode(edge.withColumn("ids", F.lit("old")))
    assert dict(got.dtypes)["ids"] == "array<int>" and set(edge.columns) < set(got.columns)


SMALL = (["<unk>", "</s>", "<0x61>", "<0x62>", "\u2581", "a", "b", "ab", "\u2581a", "bab"], ["unknown", "control", "byte", "byte"] + ["piece"] * 6)


def all_paths(word: str, log_p: np.ndarray) -> float:
    """Probability of a word by listing its segmentations."""
    texts, kinds = SMALL
    spelt = {"a": 2, "b": 3}
    s = lattice.MARK + word

    def total(at: int) -> float:
        if at == len(s):
            return 1.0
        p = sum(math.exp(log_p[i]) * total(at + len(t)) for i, (t, k) in enumerate(zip(texts, kinds)) if k == "piece" and s.startswith(t, at))
        return p + (math.exp(log_p[spelt[s[at]]]) * total(at + 1) if s[at] in spelt else 0.0)

    return total(0)


def small_table():
    table = lattice.Pieces(*SMALL)
    table.byte_ids = np.array([2 if b == 0x61 else 3 if b == 0x62 else 0 for b in range(256)])
    log_p = np.log(np.array([1e-300, 0.1, 0.02, 0.02, 0.16, 0.1, 0.1, 0.2, 0.2, 0.1]))
    return table, log_p


def test_marginal_is_the_sum_over_segmentations():
    table, log_p = small_table()
    words = ["a", "b", "ab", "abab", "babab", "aabb", "a"]
    got = lattice.log_probabilities(pa.array(words), table, lattice.Weights.of(table, log_p))
    assert np.exp(got) == pytest.approx([all_paths(w, log_p) for w in words])


def test_expected_counts_are_the_gradient():
    table, log_p = small_table()
    words, times = pa.array(["abab", "ab", "babab"]), np.array([2, 5, 1])
    got = lattice.expected_counts(words, times, table, lattice.Weights.of(table, log_p))
    for i in range(2, len(log_p)):
        moved = log_p.copy()
        moved[i] += 1e-6
        value = [(lattice.log_probabilities(words, table, lattice.Weights.of(table, p)) * times).sum() for p in (log_p, moved)]
        assert got[i] == pytest.approx((value[1] - value[0]) / 1e-6, rel=1e-3, abs=1e-4)


def test_long_words_and_utf8():
    table = lattice.Pieces(TEXTS, KINDS)
    w = lattice.Weights.of(table, lm._log(lm.first_weights(SCORES, KINDS, TEXTS)))
    got = lattice.log_probabilities(pa.array(["a" * 500, "👅", "é中", "a" * 64, "a" * 65]), table, w)
    assert np.isfinite(got).all() and (got < 0).all() and got[0] < got[4]
    spelt = lattice.utf8_bytes(np.frombuffer("aé中👅".encode("utf-32-le"), np.uint32))
    assert [[b for b in row if b < 256] for row in spelt.tolist()] == [list(c.encode()) for c in "aé中👅"]


def test_scores(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    learn = ~lm.held_out(F.col("doc_id"))
    rows = lm.score(docs, learn).collect()
    counts, held = Counter(), lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for r in docs.collect():
        if not held(r.doc_id):
            counts.update([*brute.words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == docs.count()
    for r in rows:
        tokens = [*brute.words(r.text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert r.score < 0 and math.isfinite(r.score)
    with_edges = sum(r.score for r in rows if held(r.doc_id))
    without = sum(r.score for r in lm.score(docs, learn, word_edges=False).collect() if held(r.doc_id))
    assert with_edges > without


def test_score_without_training(spark, nothing, edge):
    assert lm.score(nothing, F.lit(True)).count() == 0
    rows = lm.score(edge.where("length(text) < 200"), F.lit(False)).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.n_known for r in rows} == {0}
    assert all(math.isfinite(r.score) for r in rows)


def test_changed_input_is_noticed(spark):
    from lingweave.llm import exchange as X

    words = lambda n: spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string").coalesce(1)
    import pyarrow.compute as pc

    def times(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table["batch"])).combine_chunks()
        return X.answer_rows(table, pa.table({"times": known["times"].combine_chunks().flatten()}))

    answers = X.owned(X.words_by_owner(words(5), "text", True, 4)).groupBy("owner").applyInArrow(times, X.ANSWER)
    made = lambda: lambda chunk, place, answers, rows: [pa.array([len(place)], pa.int32())]
    assert [r.n for r in X.answered(words(5), "text", True, answers, "n int", made).collect()] == [5]
    with pytest.raises(Exception, match="store it first"):
        X.answered(words(6), "text", True, answers, "n int", made).collect()


def test_spans_give_what_whole_tables_give(spark, edge, monkeypatch):
    from lingweave.llm import exchange as X

    docs = edge.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    whole = sorted(map(str, pieces.encode(docs).collect()))
    asked = lambda: X.words_by_span(docs.coalesce(1), "text", 1).count()
    assert asked() == 1
    monkeypatch.setattr(X, "SPAN_BYTES", 1)
    monkeypatch.setattr(X, "BATCH_BYTES", 1)
    assert asked() > 1
    assert sorted(map(str, pieces.encode(docs).collect())) == whole


def test_missing_answers_are_noticed(spark, edge):
    from lingweave.llm import exchange as X
    from lingweave.llm.lines import shared_folder

    empty = shared_folder(spark, "no-answers")
    make = lambda: lambda chunk, place, answers, rows: [pa.array([0] * rows.num_rows, pa.int32())]
    with pytest.raises(Exception, match="store it first"):
        X.answered_in_place(edge.select("doc_id", "text"), "text", empty, "n int", make).collect()
