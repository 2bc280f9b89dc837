"""Whitespace as Python's ``str`` methods see it, on native Spark expressions.

Java's ``\\s`` and Spark's ``trim`` know fewer characters, so every rule that
strips, splits or collapses uses the one class below.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# The 29 code points Python counts as whitespace.
WS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = "".join(
    [chr(c) for c in range(0x09, 0x0E)]
    + [chr(c) for c in range(0x1C, 0x21)]
    + [chr(c) for c in (0x85, 0xA0, 0x1680)]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + [chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)
# The class behind two wide range tests: ordinary letters fail the first test and
# never walk the whole list, which halves the scan time.
WS_CLASS = rf"[\x00-\x20\x{{85}}-\x{{3000}}&&[{WS}]]"

SPACES = np.zeros(0x3002, bool)  # by code point; the last stands for all that follow
SPACES[[ord(c) for c in WS_CHARS]] = True


def by_code(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Entries of a table by code point; its last one stands for all that follow."""
    return table[codes] if codes.dtype == np.uint8 else table[np.minimum(codes, len(table) - 1)]


def is_space(codes: np.ndarray) -> np.ndarray:
    return by_code(SPACES, codes)


def strip(c: Column) -> Column:
    """Remove whitespace at both ends; looks at the ends only, no regex."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Turn every whitespace run into one space."""
    # a run of one plain space needs no rewrite
    return F.regexp_replace(c, f"{WS_CLASS}{{2,}}|(?! ){WS_CLASS}", " ")


def drop_whitespace(c: Column) -> Column:
    """Delete all whitespace."""
    return F.regexp_replace(c, f"{WS_CLASS}+", "")


def ws_tokens(c: Column, pieces: int = -1) -> Column:
    """Whitespace tokens; an empty or blank text gives an empty array.

    With ``pieces``, splitting stops there and the last piece holds the rest.
    """
    return F.array_remove(F.split(strip(c), f"{WS_CLASS}+", pieces), "")


def collapsed_tokens(c: Column, pieces: int = -1) -> Column:
    """:func:`ws_tokens` of a text that :func:`strip` and :func:`collapse` have passed."""
    # one plain character is cut without a regex
    return F.array_remove(F.split(c, " ", pieces), "")
