"""Word spans and hashes against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, strategies as st

from lingweave.llm import text as X

CHARS = st.text(st.sampled_from("aB9 \n\t\x0b-_é中👅.\x00\x7f"), max_size=30)


@pytest.mark.parametrize(("outside", "pattern"), [(X.WHITE, r"[^\x20\x09-\x0D]+"), (X.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@given(texts=st.lists(st.none() | CHARS, max_size=6))
def test_words_match_pattern(outside, pattern, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found: list[list[str]] = [[] for _ in texts]
    for c in X.chunks(pa.array(texts, pa.string()), X.word_table(outside), X.lower_table(), limit=16):
        for s, e, t in zip(c.starts, c.ends, c.text):
            found[c.first + t].append(c.data[s:e].tobytes().decode())
    assert found == [re.findall(pattern, (t or "").translate(lower)) for t in texts]


def test_hashes_depend_on_the_bytes_only():
    rng = np.random.default_rng(1)
    words = [rng.integers(97, 101, rng.integers(1, 6)).astype(np.uint8).tobytes() for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    c = next(X.chunks(pa.array([data.tobytes().decode()]), X.word_table(X.WHITE)))
    by_word: dict[bytes, set[int]] = {}
    for block in (64, 1 << 20):
        for w, h in zip(words, X.Hasher().spans(c.data, c.starts, c.ends, block)):
            by_word.setdefault(w, set()).add(int(h))
    assert all(len(h) == 1 for h in by_word.values())
    assert len({next(iter(h)) for h in by_word.values()}) == len(by_word)


def test_windows_are_order_sensitive():
    h = np.array([5, 7, 5, 7, 9], np.uint64)
    w = X.Hasher().windows(h, 2)
    assert w[0] == w[2] and w[0] != w[1] and len(w) == 4
    assert len(X.Hasher().windows(h[:1], 2)) == 0
