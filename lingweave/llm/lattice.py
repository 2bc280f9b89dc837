"""All segmentations of words into pieces, for many words of the same length at once.

A word is taken with the word mark in front. Every substring of at most the longest piece
length is looked up by hash, so a lattice is a set of id tables, one per length. The forward
and backward recursions run in log space over the columns of those tables. Every character
can also be spelt with its byte pieces, so every word has a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"  # fixed value: stands for the blank before a word
BLOCK = 1 << 16  # characters worked on at once
LONG = 64  # words with more characters are taken one by one
SLOT_BITS = 18

_UP = 0x9E3779B97F4A7C15


def load_pieces(path: str) -> tuple[list[str], list[float], list[str]]:
    """Texts, scores and kinds (``piece``, ``byte``, ``unknown``, ``control``) of a stored vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "piece"
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids]


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and their number per word."""
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8_bytes(points: np.ndarray) -> np.ndarray:
    """The up to four bytes of every character; 256 fills up."""
    p = points.astype(np.int64)
    out = np.full((*p.shape, 4), 256, np.int64)
    limits = [(0, 0x80, [(0, 0x00, 0x7F)]), (0x80, 0x800, [(6, 0xC0, 0x1F), (0, 0x80, 0x3F)])]
    limits += [(0x800, 0x10000, [(12, 0xE0, 0x0F), (6, 0x80, 0x3F), (0, 0x80, 0x3F)])]
    limits += [(0x10000, 0x110000, [(18, 0xF0, 0x07), (12, 0x80, 0x3F), (6, 0x80, 0x3F), (0, 0x80, 0x3F)])]
    for low, high, parts in limits:
        at = (p >= low) & (p < high)
        for i, (shift, lead, bits) in enumerate(parts):
            out[at, i] = lead | (p[at] >> shift & bits)
    return out


class Pieces:
    """A vocabulary as hash tables."""

    def __init__(self, texts: list[str], kinds: list[str]):
        self.size = len(texts)
        self.ids = np.array([i for i, k in enumerate(kinds) if k == "piece"], np.int64)
        self.byte_ids = np.array([i for i, k in enumerate(kinds) if k == "byte"], np.int64)
        normal = [texts[i] for i in self.ids]
        self.longest = max(map(len, normal), default=1)
        size = 1 << 8
        while size <= LONG + 2:
            size <<= 1
        self._powers(size)
        hashes = np.array([self._spans(np.frombuffer(t.encode("utf-32-le"), np.uint32)[None], len(t))[0, 0] for t in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], self.ids[order]
        slot = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.count = np.bincount(slot, minlength=1 << SLOT_BITS).astype(np.int16)
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count

    def _powers(self, size: int) -> None:
        up, down = np.full(size, _UP, np.uint64), np.full(size, pow(_UP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _prefixes(self, points: np.ndarray) -> np.ndarray:
        n, length = points.shape
        if length >= len(self.up):
            self._powers(1 << int(length + 1).bit_length())
        v = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xFF51AFD7ED558CCD)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(v * self.up[:length], axis=1, out=sums[:, 1:])
        return sums

    def _spans(self, points: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self._prefixes(points) if sums is None else sums
        h = (sums[:, size:] - sums[:, :-size]) * self.down[: sums.shape[1] - size] + np.uint64(size)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece id of every hash, -1 if there is none."""
        flat = h.ravel()
        out = np.full(len(flat), -1, np.int32)
        slot = (flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.flatnonzero(self.count[slot])
        slot, step = slot[left], 0
        while len(left):
            at = self.first[slot] + step
            hit = self.hashes[at] == flat[left]
            out[left[hit]] = self.ids[at[hit]]
            step += 1
            more = ~hit & (self.count[slot] > step)
            left, slot = left[more], slot[more]
        return out.reshape(h.shape)

    def tables(self, points: np.ndarray) -> list[np.ndarray]:
        """For every piece length from 1, the id of the piece that begins at each place."""
        sums = self._prefixes(points)
        return [self.lookup(self._spans(points, size, sums)) for size in range(1, min(self.longest, points.shape[1]) + 1)]


def blocks(points: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word numbers, code points with the mark`` of words of one length, some at a time."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        length = lengths[order[at]]
        same = int(np.searchsorted(lengths[order], length, "right"))
        step = 1 if length > LONG else max(1, BLOCK // (length + 1))
        for i in range(at, same, step):
            rows = order[i : min(i + step, same)]
            table = np.empty((len(rows), length + 1), np.uint32)
            table[:, 0] = ord(MARK)
            table[:, 1:] = points[starts[rows][:, None] + np.arange(length)]
            yield rows, table
        at = same


@dataclass
class Weights:
    """Log probability of every piece, and of every byte (index 256 is nothing)."""

    piece: np.ndarray
    byte: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces, log_p: np.ndarray) -> Weights:
        return cls(log_p, np.append(log_p[pieces.byte_ids], 0.0))


def forward(tables: list[np.ndarray], spelt: np.ndarray, w: Weights) -> np.ndarray:
    """Log probability of every prefix, over all segmentations."""
    n, length = spelt.shape
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0.0
    for e in range(1, length + 1):
        total = alpha[:, e - 1] + spelt[:, e - 1]
        for size, table in enumerate(tables[:e], 1):
            ids = table[:, e - size]
            has = np.flatnonzero(ids >= 0)
            if len(has):
                total[has] = np.logaddexp(total[has], alpha[has, e - size] + w.piece[ids[has]])
        alpha[:, e] = total
    return alpha


def backward(tables: list[np.ndarray], spelt: np.ndarray, w: Weights) -> np.ndarray:
    """Log probability of every suffix, over all segmentations."""
    n, length = spelt.shape
    beta = np.full((n, length + 1), -np.inf)
    beta[:, length] = 0.0
    for s in range(length - 1, -1, -1):
        total = beta[:, s + 1] + spelt[:, s]
        for size, table in enumerate(tables[: length - s], 1):
            ids = table[:, s]
            has = np.flatnonzero(ids >= 0)
            if len(has):
                total[has] = np.logaddexp(total[has], beta[has, s + size] + w.piece[ids[has]])
        beta[:, s] = total
    return beta


def log_probabilities(words: pa.Array, pieces: Pieces, w: Weights) -> np.ndarray:
    """Natural log of the marginal probability of every word."""
    out = np.zeros(len(words))
    for rows, points in blocks(*code_points(words)):
        tables = pieces.tables(points)
        out[rows] = forward(tables, w.byte[utf8_bytes(points)].sum(-1), w)[:, -1]
    return out


def expected_counts(words: pa.Array, times: np.ndarray, pieces: Pieces, w: Weights) -> np.ndarray:
    """Expected uses of every piece when each word occurs ``times``."""
    out = np.zeros(pieces.size)
    for rows, points in blocks(*code_points(words)):
        tables, spelling = pieces.tables(points), utf8_bytes(points)
        spelt = w.byte[spelling].sum(-1)
        alpha, beta = forward(tables, spelt, w), backward(tables, spelt, w)
        total, n = alpha[:, -1:], times[rows][:, None]
        for size, table in enumerate(tables, 1):
            row, start = np.nonzero(table >= 0)
            ids = table[row, start]
            p = np.exp(alpha[row, start] + w.piece[ids] + beta[row, start + size] - total[row, 0])
            out += np.bincount(ids, p * n[row, 0], pieces.size)
        p = np.exp(alpha[:, :-1] + spelt + beta[:, 1:] - total) * n
        for k in range(4):
            used = spelling[..., k] < 256
            out += np.bincount(pieces.byte_ids[spelling[..., k][used]], p[used], pieces.size)
    return out
