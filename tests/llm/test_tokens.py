"""Token attribution by offsets."""

from __future__ import annotations

import numpy as np
import pytest
import tiktoken

from lingweave.llm import tokens


@pytest.fixture(scope="module")
def encoder() -> tiktoken.Encoding:
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.load_ranks(f.read())[0]


def expected(encoder, text: str, edges: list[tuple[int, int]], rule: str) -> tuple[list[int], int]:
    """Tokens per section by looking at every byte of every token."""
    owner, at = [], 0
    for i, c in enumerate(text):
        section = next((n for n, (s, e) in enumerate(edges) if s <= i < e), -1)
        owner += [section] * len(c.encode())
    counts, outside = [0] * len(edges), 0
    for t in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(t))
        own = owner[at : at + size]
        at += size
        inside = [x for x in own if x >= 0]
        chosen = own[0] if rule == "first" else own[-1] if rule == "last" else min(set(inside), key=lambda x: (-inside.count(x), x), default=-1)
        if chosen >= 0:
            counts[chosen] += 1
        else:
            outside += 1
    return counts, outside


@pytest.mark.parametrize("rule", tokens.RULES)
def test_spans(spark, encoder, rule):
    texts = ["Hello world, again\n\nnew  line", "中文👅 text中", "", "abcdef" * 4, "a b c"]
    edges = [[(0, 3), (3, 9), (9, 14), (20, 25)], [(0, 1), (1, 3), (4, 9)], [], [(0, 1), (1, 2), (2, 3), (7, 24)], [(2, 3)]]
    rows = [(i, t, [(*e,) for e in s]) for i, (t, s) in enumerate(zip(texts, edges))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:long,end:long>>")
    for r in tokens.count_tokens(frame, spans="spans", rule=rule).collect():
        counts, outside = expected(encoder, r.text, edges[r.doc_id], rule)
        assert (r.section_tokens, r.unattributed) == (counts, outside)
        assert r.n_tokens == len(encoder.encode_ordinary(r.text)) == sum(counts) + outside


def test_lines_and_edge_cases(encoder, edge, nothing):
    rows = tokens.count_tokens(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == len(encoder.encode_ordinary(text)) == sum(r.section_tokens)
        assert r.n_sections == len(text.splitlines(True)) or "\r" in text
        if len(text) < 200:
            starts = np.cumsum([0] + [len(x) for x in text.split("\n")[:-1]]) + np.arange(text.count("\n") + 1)
            edges = [(a, b) for a, b in zip(starts, [*starts[1:], len(text)]) if a < len(text)]
            assert r.section_tokens == expected(encoder, text, edges, "first")[0]
    assert tokens.count_tokens(nothing).count() == 0


def test_fields(spark, encoder):
    frame = spark.createDataFrame([("Title", None, "some body text"), (None, None, None)], "title string, lead string, body string")
    first, second = tokens.attribute_fields(frame, ["title", "lead", "body"]).collect()
    assert first.n_tokens == len(encoder.encode_ordinary("Title\n\nsome body text")) == sum(first.section_tokens) + first.unattributed
    assert first.section_tokens[1] == 0 and second.section_tokens == [0, 0, 0]


def test_unknown_rule(edge):
    with pytest.raises(ValueError, match="one of"):
        tokens.count_tokens(edge, rule="middle")
