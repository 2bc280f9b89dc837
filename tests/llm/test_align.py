"""Both tokenizers on whole texts by their own libraries, and groups and links by sets of offsets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, strategies as st
from tokenizers import Tokenizer

from lingweave.functions.tokens import byte_characters
from lingweave.llm import align
from lingweave.llm.queries import QUERIES
from tests.llm.brute import sha256

VALUE = {ch: b for b, ch in enumerate(byte_characters())}


@pytest.fixture(scope="module")
def both():
    left = Tokenizer.from_file(align.VOCABULARY_A)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=align.VOCABULARY_B)


def spelt(both, text):
    """Ids and token bytes of both sides, or nothing."""
    left, right = both
    a = left.encode(" " + text, add_special_tokens=False).ids
    b = right.encode(text)
    bytes_a = [bytes(VALUE[c] for c in left.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, b, bytes_a, bytes_b) if text and b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def plain(both, rows):
    """The rows of the query, links by comparing the byte ranges of tokens near each other."""
    made, counts = [], Counter()
    for i, text in rows:
        a, b, bytes_a, bytes_b = spelt(both, text or "")
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        shown = []
        for s, e in zip([0, *cuts], cuts):
            own = [(ids, [x for x, _ in at], [y for _, y in at]) for ids, at in ((a, at_a), (b, at_b))]
            shown.append("|".join(",".join(map(str, ids[bisect_left(opens, s) : bisect_right(closes, e)])) for ids, opens, closes in own))
        ends_b, starts_b = [v for _, v in at_b], [u for u, _ in at_b]
        links = [(p, q) for p, (s, e) in zip(a, at_a) for q in b[bisect_right(ends_b, s) : bisect_left(starts_b, e)]]
        counts.update(links)
        made.append((i, len(a), len(b), len(cuts), links, ";".join(shown)))
    best = defaultdict(int)
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    return Counter(
        (i, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha256(shown) if shown else "", shown)
        for i, n_a, n_b, n_groups, links, shown in made
    )


HARD = [
    "plain words and more words, plain again",
    " leading and trailing ",
    "two  blanks   three\n\n  lines \t tabs\r\nend ",
    "a b  c　 d\u0085 e \x1c f",
    "mark ▁ inside",
    "▁",
    "<|endoftext|> <s></s><unk> <0x0A> [INST]",
    "\U0001f445 emoji \U0001f469‍\U0001f52c joined, accents é été naïve",
    "日本語 のテキスト العربية привет мир",
    "don't we'll I'VE 'tis o'clock's",
    "\x00\x01�﻿ nul",
    " ",
    "   ",
    "\n",
    "x" * 500 + " " + "ab" * 300,
    "1234567890 12 345 6,789.01",
    "# ## ### ==== ---- ,,, ;;;",
]


def rows_of(frame, *names):
    return Counter(tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *names).collect())


@pytest.mark.parametrize("batch_bytes", [1, align.BATCH_BYTES])
def test_hard_texts(spark, both, batch_bytes):
    rows = [*enumerate(HARD), (3, None), (4, ""), (None, HARD[0]), (0, HARD[0]), (99, " ".join(HARD[:4] + HARD[6:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(align.align(docs, groups=True, batch_bytes=batch_bytes), "groups") == plain(both, rows)


def test_fixture(spark, both, edge):
    found = align.align(edge)
    assert found.columns == ["doc_id", "lang", "n_words", "score", "a.b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 10_000]
    expected = plain(both, short)
    got = rows_of(align.align(edge.where("text is null or length(text) < 10000")))
    assert got == Counter({k[:-1]: v for k, v in expected.items()})
    sizes = {r.n_a for r in found.where("doc_id = 7 and n_a > 10000").collect()}
    assert sizes == {len(both[0].encode(" " + max((t or "" for _, t in rows), key=len), add_special_tokens=False).ids)}


def test_query(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_alignment"](spark, sf)) == Counter({k[:-1]: v for k, v in plain(both, rows).items()})


def test_empty(spark, nothing):
    assert align.align(nothing).count() == 0


@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), max_size=40), st.integers(0, 200))
def test_groups_are_shared_ends(first, second, run):
    shift = lambda ends: sorted({61 + run, *ends, *range(61, 61 + run)})
    a, b = np.array(shift(first)), np.array(shift(second))
    ends_a, ends_b = align.diagonal_groups(a, b)
    shared = np.intersect1d(a, b)
    assert np.array_equal(a[ends_a - 1], shared) and np.array_equal(b[ends_b - 1], shared)
