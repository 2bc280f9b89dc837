"""Tokenisers as native expressions: 13a for BLEU, byte-level pieces for BPE."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from lingweave.functions.whitespace import SPACES, by_code

# The byte-level pre-tokeniser pattern of GPT-2, Unicode-aware.
PIECE_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# The 13a rules of the WMT scoring scripts (Post 2018), in order.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SPLIT_RULES = [
    (r"([\{-~\[-\x60!-&\(-\+:-@/])", " $1 "),  # symbols
    (r"([^0-9])([.,])", "$1 $2 "),  # period or comma unless a digit precedes
    (r"([.,])([^0-9])", " $1 $2"),  # period or comma unless a digit follows
    (r"([0-9])(-)", "$1 $2 "),  # dash after a digit
]


def tokenize_13a(c: Column) -> Column:
    """Text with 13a token borders as whitespace; split it on whitespace."""
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES]:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in SPLIT_RULES:
        c = F.regexp_replace(c, pattern, to)
    return c


# The classes the 13a rules tell apart, by code point.
OTHER, SPACE, SYMBOL, POINT, DIGIT, DASH = range(6)
CLASSES = SPACES.astype(np.uint8)
CLASSES[[*range(0x21, 0x27), *range(0x28, 0x2C), 0x2F, *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = SYMBOL
CLASSES[[0x2C, 0x2E]] = POINT
CLASSES[0x30:0x3A] = DIGIT
CLASSES[0x2D] = DASH


def unescape_13a(text: str) -> str:
    """The replacements of :func:`tokenize_13a` for a text whose line feeds are whitespace anyway."""
    text = text.replace("<skipped>", "").replace("-\n", "")
    if "&" in text:
        for old, new in ENTITIES:
            text = text.replace(old, new)
    return text


def word_starts_13a(codes: np.ndarray) -> np.ndarray:
    """Where the words of :func:`tokenize_13a` start, for unescaped texts with a space before, between and behind them.

    A character the rules put space around stands alone: a symbol, a dash after a digit, and a period or
    comma, unless it ends its run of them before a digit and no match of ``[^0-9][.,]`` ends in it. Those
    matches take two characters each, the first of them the one before the run if that is no digit.
    """
    kinds = by_code(CLASSES, codes)
    alone = kinds == SYMBOL
    dashes = np.flatnonzero(kinds == DASH)
    alone[dashes[kinds[dashes - 1] == DIGIT]] = True
    points = np.flatnonzero(kinds == POINT)
    alone[points] = True
    first = np.append(True, np.diff(points) > 1)[: len(points)]
    start = points[np.maximum.accumulate(np.where(first, np.arange(len(points)), 0))]
    odd = (points - start) % 2 == 0
    kept = (kinds[points + 1] == DIGIT) & (odd == (kinds[start - 1] == DIGIT))
    alone[points[kept]] = False
    space = kinds == SPACE
    starts = ~space
    starts[1:] &= alone[1:] | alone[:-1] | space[:-1]
    return starts


def pretokenize(c: Column) -> Column:
    """Array of pieces whose concatenation is the text."""
    return F.regexp_extract_all(c, F.lit(PIECE_PATTERN), 0)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value 0..255.

    Rule of byte-level BPE: visible Latin-1 characters stand for themselves, the
    other bytes take the code points from 256 on, in byte order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


# A symbol id travels as one character of the supplementary planes, so a word is
# a plain string, a pair is two characters and a merge is a native ``replace``.
SYMBOL_BASE = 0x10000


def symbol(token_id: int) -> str:
    return chr(SYMBOL_BASE + token_id)


def symbol_ids(symbols: str) -> list[int]:
    return [ord(s) - SYMBOL_BASE for s in symbols]


def byte_alphabet(first_id: int) -> dict[str, int]:
    """Ids of the 256 byte characters, in code-point order from ``first_id``."""
    return {ch: first_id + i for i, ch in enumerate(sorted(byte_characters()))}


def piece_symbols(c: Column, first_id: int) -> Column:
    """A piece as a string of byte symbols."""
    ids = byte_alphabet(first_id)
    latin = "".join(chr(b) for b in range(256))
    target = "".join(symbol(ids[ch]) for ch in byte_characters())
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), latin, target)
