"""Cleaning rules against hand-written results and against Python's own string methods."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lingweave.functions import clean as C
from lingweave.functions.whitespace import WS_CHARS, collapse, strip, ws_tokens
from lingweave.operators.cleaning import clean_columns, clean_report


def run(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


GOLDEN = [
    # text, full chain, letters-only chain keeping hashtag text and removing emoji
    ("RT <user> : go go ... #SomeTag https://x.y/z", "rt : go go .", "rt go go sometag"),
    ("<user> Hola ... #bien", "hola .", "hola bien"),
    ("One//Two * tres *", "one//two * tres *", "onetwo tres"),
    ("quiero pan \U0001f445", "quiero pan", "quiero pan"),
    ("RT : a@b.c  #x y!!!??..", "a y!?.", "abc x y"),
    ("x　y  z​ 中文", "xy z​", "xy z"),
    ("Ünï HTTP://A http://b c", "ünï http://a c", "n httpa c"),
    ("नमस्ते ☀️ ok➡ é", "नमस्ते ok é", "ok"),
    ("", "", ""),
    ("@#tag @ #", "@ @ #", "tag"),
]


def test_golden(spark):
    texts = [g[0] for g in GOLDEN]
    assert run(spark, texts, C.clean_text) == [g[1] for g in GOLDEN]
    alpha = run(spark, texts, lambda c: C.clean_text_alpha(c, retain_hashtag_text=True, remove_emoji=True))
    assert alpha == [g[2] for g in GOLDEN]


def test_retained_hashtags_keep_mentions(spark):
    assert run(spark, ["#a @b"], lambda c: C.remove_hashtags_and_mentions(c, True)) == ["a @b"]


def test_emoji_option(spark):
    assert run(spark, ["a中\U0001f600"], lambda c: C.handle_emojis(c)) == ["a中\U0001f600"]
    assert run(spark, ["a中\U0001f600"], lambda c: C.handle_emojis(c, True)) == ["a"]
    assert run(spark, ["a中\U0001f600☀"], lambda c: C.handle_emojis(c, True, narrow=True)) == ["a中"]


def test_lower_special_letters(spark):
    texts = ["İstanbul", "ΟΔΟΣ", "ẞ"]
    assert run(spark, texts, C.to_lowercase) == [t.lower() for t in texts]


def test_null_stays_null(spark):
    assert run(spark, [None], C.clean_text) == [None]


def test_whitespace_is_pythons(spark):
    assert len(WS_CHARS) == 29 and all(c.isspace() for c in WS_CHARS)
    texts = [f"a{c}{c}b{c}" for c in WS_CHARS] + ["a​b"]
    assert run(spark, texts, lambda c: collapse(strip(c))) == [" ".join(t.split()) for t in texts]
    assert run(spark, texts + ["", "  "], ws_tokens) == [t.split() for t in texts + ["", "  "]]


PIECES = st.lists(
    st.sampled_from(
        ["http", "://a", "<user>", "RT :", "RT", ":", "#", "@", "x", "É", "!", "!!", ".", "..", "?", " ", "\t", "\n",
         " ", "　", "\U0001f600", "☀", "​", "9"]
    ),
    max_size=14,
).map("".join)


def reference_chain(t: str) -> str:
    """The chain spelt with Python's regex engine."""
    t = re.sub(r"http\S+", "", t).replace("<user>", "").strip().replace("RT :", "").strip()
    t = re.sub(r"@\S+", "", re.sub(r"#\S+", "", t))
    emoji = "".join(f"{chr(a)}-{chr(b)}" for a, b in C.EMOJI_RANGES)
    t = re.sub(f"[{emoji}]+", "", t)
    for mark in "!.?":
        t = re.sub(re.escape(mark) + "+", mark, t)
    return re.sub(r"\s+", " ", t.lower().strip())


@settings(max_examples=6, deadline=None)
@given(st.lists(PIECES, min_size=40, max_size=80))
def test_chain_equals_python(spark, texts):
    assert run(spark, texts, C.clean_text) == [reference_chain(t) for t in texts]


def test_clean_columns_leaves_others(spark):
    df = spark.createDataFrame([("A!!", "B!!", "C!!")], "hi_en string, en string, source string")
    assert tuple(clean_columns(df, ["hi_en", "en"]).first()) == ("a!", "b!", "C!!")


def test_report_adds_up(spark):
    texts = [g[0] for g in GOLDEN]
    df = spark.createDataFrame([("s", t) for t in texts], "source string, text string")
    removed = clean_report(df, "text", "source").agg(F.sum("chars_removed")).first()[0]
    assert removed == sum(len(g[0]) - len(g[1]) for g in GOLDEN)


@pytest.mark.parametrize("size", [200_000])
def test_long_texts_do_not_overflow(spark, size):
    text = ("é, " * size) + "(" * size
    assert run(spark, [text], lambda c: F.length(C.clean_text_alpha(c))) == [0]
