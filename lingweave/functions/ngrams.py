"""Clipped n-gram match counts of sentence pairs, one Arrow batch at a time.

The counts of a pair need that pair only, so they are taken where the row lies:
no gram is ever shuffled, and what leaves the stage is a handful of integers per
row that any later grouping can add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from lingweave.functions.tokens import unescape_13a, word_starts_13a
from lingweave.functions.whitespace import is_space

MAX_UNITS_PER_CHUNK = 50_000  # numbers of a chunk stay in the processor cache


def _chunks(sizes: np.ndarray, limit: int = MAX_UNITS_PER_CHUNK) -> Iterator[slice]:
    """Row ranges of at most ``limit`` units, so memory does not follow batch size."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.array(list(chain.from_iterable(split)), dtype=object), sizes


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), sizes


def clipped_matches(codes: np.ndarray, sizes: np.ndarray, sides: int, max_order: int) -> np.ndarray:
    """Array ``[sides - 1, rows, max_order]``: the grams each other text of a row shares with its first text.

    ``codes`` are the units of all texts as numbers from 0, ``sizes`` their lengths: the first texts of all
    rows, then the second ones, and so on. A place gives one number, made of its row, the units from there on
    and its side. Sorted once, equal grams of every order are neighbours, since a gram starts with the
    shorter ones. Units that do not fit follow in another pass, behind the rank of those before.
    """
    rows = len(sizes) // sides
    out = np.zeros((sides - 1, rows, max_order), np.int64)
    if not len(codes):
        return out
    if sides > 2 and int(sizes.max()) >> 64 // sides:  # counts of all sides would not fit one number
        parts, lengths = np.split(codes, np.cumsum(sizes.reshape(sides, rows).sum(axis=1))[:-1]), np.split(sizes, sides)
        pairs = [(np.concatenate([parts[0], parts[k]]), np.concatenate([lengths[0], lengths[k]])) for k in range(1, sides)]
        return np.concatenate([clipped_matches(*pair, 2, max_order) for pair in pairs])
    # a border behind each text has a code per side, so no gram over it is shared
    border = int(codes.max()) + 1
    room = sizes + 1
    ends = np.cumsum(room) - 1
    total = int(ends[-1]) + 1
    side = np.repeat(np.arange(sides, dtype=np.uint64), rows)
    inside = np.ones(total, bool)
    inside[ends] = False
    units = np.full(total + max_order, border + sides - 1, np.uint64)
    units[:total][inside] = codes
    units[ends] = side + np.uint64(border)
    mark = np.repeat(side, room)
    head = np.repeat(np.tile(np.arange(rows, dtype=np.uint64), sides), room)
    row_room = room.reshape(sides, rows).sum(axis=0)
    row_starts = np.cumsum(row_room) - row_room
    head_bits, unit_bits, side_bits = rows.bit_length(), (border + sides - 1).bit_length(), (sides - 1).bit_length()
    count_bits = np.uint64(64 // sides)
    done = 0
    while done < max_order:
        fit = min(max_order - done, (64 - head_bits - side_bits) // unit_bits)
        keys = head.copy()
        for k in range(done, done + fit):
            keys <<= np.uint64(unit_bits)
            keys |= units[k : k + total]
        keys <<= np.uint64(side_bits)
        keys |= mark
        place = None
        if done + fit < max_order:
            place = np.argsort(keys)
            keys = keys[place]
        else:
            keys.sort()
        # places so far of every side, side by side in one number; differences stay right when it overflows
        upto = np.cumsum(np.uint64(1) << (keys & np.uint64((1 << side_bits) - 1)) * count_bits)
        keys >>= np.uint64(side_bits)
        step = np.full(total, ~np.uint64(0))
        np.bitwise_xor(keys[1:], keys[:-1], out=step[:-1])
        last = np.flatnonzero(step != 0)  # last place of every gram
        step, upto = step[last], upto[last]
        for order in range(done + fit, done, -1):
            if order < done + fit:
                kept = np.flatnonzero(step >= np.uint64(1 << unit_bits * (done + fit - order)))
                step, last, upto = step[kept], last[kept], upto[kept]
            starts = np.searchsorted(last, row_starts)
            held = upto.copy()
            held[1:] -= upto[:-1]
            first, *others = ((held >> np.uint64(s) * count_bits) & np.uint64((1 << int(count_bits)) - 1) for s in range(sides))
            for k, other in enumerate(others):
                out[k, :, order - 1] = np.add.reduceat(np.minimum(first, other), starts)
            if order == done + fit and place is not None:
                head = np.empty(total, np.uint64)
                head[place] = np.repeat(np.arange(len(last), dtype=np.uint64), np.diff(last, prepend=-1))
                head_bits = len(last).bit_length()
        done += fit
    return out


def _counts(codes: np.ndarray, sizes: np.ndarray, sides: int, max_order: int) -> np.ndarray:
    """Array ``[sides - 1, rows, 3 * max_order]`` of (matches, hyp grams, ref grams) per order; the first side is the reference."""
    matches = clipped_matches(codes, sizes, sides, max_order)
    grams = np.maximum(sizes.reshape(sides, -1, 1) - np.arange(max_order), 0)
    refs = np.broadcast_to(grams[:1], matches.shape)
    return np.stack([matches, grams[1:], refs], axis=3).reshape(*matches.shape[:2], 3 * max_order)


def match_counts(hyp: list[str], ref: list[str], max_order: int, words: bool) -> np.ndarray:
    """Array ``[rows, 3 * max_order]`` of (matches, hyp grams, ref grams) per order."""
    units, sizes = (_words if words else _characters)(ref + hyp)
    return _counts(pd.factorize(units)[0], sizes, 2, max_order)[0]


def _dense(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 without gaps for character codes."""
    if not len(codes):
        return codes
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    return (np.cumsum(seen, dtype=np.int32) - 1)[codes]


def _joined(texts: list[str]) -> np.ndarray:
    """The characters of all texts, with a space before, between and behind them."""
    text = f" {' '.join(texts)} "
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _word_codes(codes: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the 13a words and their count per text; ``places`` are those of characters, ``bounds`` the texts' first ones among them."""
    starts = np.flatnonzero(word_starts_13a(codes)[places])
    characters = codes[places]
    offsets = np.append(starts, len(characters)) * characters.itemsize
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(characters)])
    return words.dictionary_encode().indices.to_numpy(), np.diff(np.searchsorted(starts, bounds))


def _places(codes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the characters that are no whitespace, and the number of them before each text and behind all."""
    places = np.flatnonzero(~is_space(codes))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return places, np.concatenate([[0], np.searchsorted(places, ends)])


def text_counts(columns: Sequence[list[str]], orders: tuple[int, int]) -> np.ndarray:
    """Array ``[hyps, rows, 3 * sum(orders)]`` of 13a word and of character counts; the first column is the reference."""
    texts = list(chain.from_iterable(columns))
    codes = _joined(texts)
    places, bounds = _places(codes, texts)
    characters = _counts(_dense(codes[places]), np.diff(bounds), len(columns), orders[1])
    plain = [unescape_13a(t) for t in texts]
    if plain != texts:
        codes = _joined(plain)
        places, bounds = _places(codes, plain)
    words = _counts(*_word_codes(codes, places, bounds), len(columns), orders[0])
    return np.concatenate([words, characters], axis=2)


def stat_names(prefix: str, max_order: int) -> list[str]:
    return [f"{prefix}_{kind}{n}" for n in range(1, max_order + 1) for kind in ("match", "hyp", "ref")]


def ngram_stats(hyp: Column, ref: Column, max_order: int, words: bool, prefix: str) -> Column:
    """Struct of counts per order; ``words`` splits on whitespace, else characters."""
    names = stat_names(prefix, max_order)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    @F.pandas_udf(schema)
    def stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, r in batches:
            h, r = h.fillna(""), r.fillna("")
            sizes = (h.str.len() + r.str.len()).to_numpy()
            parts = [
                match_counts(h[rows].tolist(), r[rows].tolist(), max_order, words)
                for rows in _chunks(sizes)
            ]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int64)
            yield pd.DataFrame(counts, columns=names)

    return stats(hyp, ref)


def _texts(column: pa.Array) -> list[str]:
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.large_binary()).to_pylist()]


def word_and_character_stats(ref: Column, hyps: Sequence[Column], orders: tuple[int, int], prefixes: tuple[str, str]) -> Column:
    """Struct ``h0, h1, ...`` with a struct per hypothesis of its 13a word and character counts, all in one Arrow step."""
    names = [*stat_names(prefixes[0], orders[0]), *stat_names(prefixes[1], orders[1])]
    one = T.StructType([T.StructField(c, T.LongType()) for c in names])
    schema = T.StructType([T.StructField(f"h{k}", one) for k in range(len(hyps))])

    @F.arrow_udf(schema)
    def stats(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            texts = [_texts(c) for c in columns]
            sizes = np.sum([np.fromiter(map(len, t), np.int64, len(t)) for t in texts], axis=0)
            parts = [text_counts([t[rows] for t in texts], orders) for rows in _chunks(sizes)]
            counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(texts) - 1, 0, len(names)), np.int64)
            structs = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in hyp.T], names) for hyp in counts]
            yield pa.StructArray.from_arrays(structs, [f"h{k}" for k in range(len(structs))])

    return stats(ref, *hyps)
