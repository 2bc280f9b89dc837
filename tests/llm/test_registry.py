"""The registered queries and the pipeline."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from lingweave.llm.oracle import ORACLE
from lingweave.llm.queries import QUERIES
from tests.llm import brute


def test_names():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "sentence_pieces"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in "documents benchmark labels pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = QUERIES[name](spark, sf)
    got = sorted(map(tuple, frame.collect()), key=repr)
    expected = con.sql(ORACLE[name]).project(", ".join(frame.columns)).fetchall()
    assert got == sorted(expected, key=repr)


def test_near_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = brute.near_components(docs)
    for r in QUERIES["op9_near_duplicates"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(brute.shingles(docs[r.doc_id])), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_chat_query(spark, sf):
    said = "\\### Assistant: </turn> ok"
    by = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows = QUERIES["op6_chat_format"](spark, sf).collect()
    assert len(rows) == len(by)
    for r in rows:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha256(loss))


def test_warc_query(spark, sf):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    top = {}
    for i, page in pages.items():
        top[page] = max(i, top.get(page, i))
    for r in QUERIES["op10_warc"](spark, sf).collect():
        data = pages[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        revisit = top[pages[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", top[pages[r.page_id]]) if revisit else ("response", None))


def test_pipeline_stages(spark, sf):
    """Every stage against the plain version on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentence_pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(r.text == before[i] for i, r in after.items())
        gone = set(before) - set(after)
        if name == "quality_rules":
            assert {i for i, t in before.items() if brute.base_counts(t)[-1]} <= gone
            assert not any(labels.get(i) and not brute.base_counts(before[i])[-1] for i in gone)
        elif name == "language_id":
            assert not gone
        elif name == "near_dedup":
            expected = brute.near_components(before, 5, 80)
            assert set(after) == {i for i, c in expected.items() if i == c}
        elif name == "decontamination":
            judged = {i: brute.contamination(t, items) for i, t in before.items()}
            assert gone == {i for i, (n, hit, _) in judged.items() if hit and 20 * hit >= n}
        else:
            assert not gone and all(r.round_trip and r.n_pieces == len(r.ids) for r in after.values())
        before = {i: getattr(r, "text", None) for i, r in after.items()}
