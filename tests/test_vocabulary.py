"""Byte-pair queries with a whole vocabulary against the tokenizers library, on the smallest tables, whole texts."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import ByteLevelBPETokenizer, Tokenizer

import __spark_entry__ as entry
from lingweave.functions import arrays as A
from lingweave.operators import bpe
from lingweave.operators.bpe import FIRST_BYTE
from lingweave.plans import queries as Q, tables as T

JSON = "/opt/tokenizers/byte_bpe_50k.json"


def ready_library():
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return tok


def texts_of(spark, sf, table="documents", key="doc_id"):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key, "text").collect()}


def trained_library(texts, merges):
    tok = ByteLevelBPETokenizer()
    tok.train_from_iterator(texts, vocab_size=260 + merges, min_frequency=1, special_tokens=A.SPECIAL_TOKENS, show_progress=False)
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(tok.to_str())["model"]["merges"]]


def run(spark, sf, name):
    return entry.queries()[f"bpe_{name}_vocabulary"](spark, sf)


def test_registered_beside_the_small_ones():
    names = "train incremental tokenize encode_pairs decode token_totals denoise vocab_styles append".split()
    assert {f"bpe_{n}_vocabulary" for n in names} <= set(entry.queries())
    assert Q.VOCABULARY_MERGES >= 8000


def test_merges_equal_the_library(spark, sf):
    expected = trained_library([t for t in texts_of(spark, sf).values() if t], Q.VOCABULARY_MERGES)
    rows = run(spark, sf, "train").orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in rows] == expected and len(rows) == Q.VOCABULARY_MERGES


def test_incremental_keeps_the_first_merges(spark, sf):
    rows = run(spark, sf, "incremental").orderBy("rank").collect()
    assert len(rows) == Q.MORE_VOCABULARY_MERGES
    first = trained_library([t for t in texts_of(spark, sf).values() if t], Q.VOCABULARY_MERGES)
    assert [(r["left"], r["right"]) for r in rows[: Q.VOCABULARY_MERGES]] == first


def test_tokens_equal_the_library(spark, sf):
    tok, texts = ready_library(), texts_of(spark, sf)
    expected = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in run(spark, sf, "tokenize").collect()} == expected
    totals = run(spark, sf, "token_totals").collect()
    assert sum(r.tokens for r in totals) == sum(expected.values())
    assert {r.doc_id: r.text for r in run(spark, sf, "decode").collect()} == texts


def test_pairs_equal_the_library(spark, sf):
    tok = ready_library()
    given = {r.row_id: r for r in T.pairs(spark, sf).collect()}
    rows = run(spark, sf, "encode_pairs").collect()
    assert len(rows) == len(given)
    for r in rows:
        for ids, text, pad in ((r.input_ids, given[r.row_id].hi_en, 1), (r.labels, given[r.row_id].en, -100)):
            own = [0, *[i + FIRST_BYTE for i in tok.encode(text or "", add_special_tokens=False).ids[:28]], 2]
            assert ids == " ".join(map(str, own + [pad] * (30 - len(own))))


def test_windows_cover_all_tokens(spark, sf):
    tok, texts = ready_library(), texts_of(spark, sf)
    rows = run(spark, sf, "denoise").collect()
    assert len(rows) == sum(max(1, -(-len(tok.encode(t, add_special_tokens=False).ids) // 28)) for t in texts.values())


def test_styles_over_the_ready_vocabulary(spark, sf):
    by = {}
    for r in run(spark, sf, "vocab_styles").collect():
        by.setdefault(r.style, {})[r.id] = r.token
    base = ready_library().get_vocab()
    assert {t for t, i in base.items() if i < 50_256} <= set(by["DEFAULT"].values()) and len(by["DEFAULT"]) == 50_256 + 5
    assert len(by["SCRATCH"]) == 256 + Q.VOCABULARY_MERGES + 5
    lacking = [t for _, t in sorted(by["SCRATCH"].items()) if t not in set(by["DEFAULT"].values())]
    assert [t for _, t in sorted(by["APPEND"].items())][len(by["DEFAULT"]) :] == lacking and sorted(by["APPEND"]) == list(range(len(by["APPEND"])))


def test_appended_tokens_equal_the_library(spark, sf):
    turns = [r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").select("text").collect() if r.text]
    merges = trained_library(turns, Q.VOCABULARY_MERGES)
    tok = ready_library()
    lacking = [t for t in dict.fromkeys(a + b for a, b in merges) if tok.token_to_id(t) is None]
    tok.add_tokens(lacking)
    first = tok.token_to_id(lacking[0])
    mask = FIRST_BYTE + 50_256
    texts = texts_of(spark, sf)
    for r in run(spark, sf, "append").collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        own = [i + FIRST_BYTE if i < 50_256 else i - first + mask + 1 for i in ids]
        assert (r.n_tokens, r.n_added) == (len(own), sum(i > mask for i in own))
        assert r.ids == hashlib.md5(",".join(map(str, own)).encode()).hexdigest()


def test_words_are_merged_many_at_once(spark, monkeypatch):
    draw = random.Random(3)
    merges: list[bpe.Merge] = []
    for rank in range(60):
        merges.append(bpe.Merge(rank, *(draw.choice([5, 6, 7, *[m.merged for m in merges]]) for _ in range(2))))
    ranks = bpe._ranks(merges)
    words = [[draw.randrange(5, 8) for _ in range(draw.randrange(24))] for _ in range(500)] + [[5] * 7, [6, 6, 6], [], [5, 6] * 200, [7] * 65]
    expected = [bpe._apply(word, ranks) for word in words]
    alone = []
    monkeypatch.setattr(bpe, "_apply", lambda word, ranks, apply=bpe._apply: alone.append(len(word)) or apply(word, ranks))
    ids, sizes = np.array([x for w in words for x in w], np.int64), np.array(list(map(len, words)))
    merged, after = bpe.merge_words(ids, sizes, *bpe._rank_table(ranks))
    assert [w.tolist() for w in np.split(merged, np.cumsum(after)[:-1])] == expected and not alone
    monkeypatch.undo()
    rows = [(i, "".join(map(bpe.symbol, w))) for i, w in enumerate(words)] + [(len(words), None)]
    got = spark.createDataFrame(rows, "i int, symbols string").select("i", bpe.replay(F.col("symbols"), merges, spark).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["".join(map(bpe.symbol, w)) for w in expected] + [None]
