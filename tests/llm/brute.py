"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(LOWER))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def contamination(text: str | None, items: list[tuple[int | None, str | None]], size: int = 13) -> tuple[int, int, list[int]]:
    """Words, hit words and ids of the items that occur."""
    own, hit, found = alnum_words(text), set(), set()
    for item_id, item in items:
        w = alnum_words(item)
        windows = [w] if 0 < len(w) < size else [w[i : i + size] for i in range(len(w) - size + 1)]
        for window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item_id)
    return len(own), len(hit), sorted(i for i in found if i is not None)


def shingles(text: str | None, size: int = 3) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def roots(count: int, edges) -> list[int]:
    """Smallest member of the component of each of 0 .. count - 1."""
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def near_components(docs: dict[int, str | None], size: int = 3, similarity: int = 85) -> dict[int, int]:
    ids = sorted(docs)
    sets = [shingles(docs[i], size) for i in ids]
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            holders[x].append(n)
    edges = []
    for n, s in enumerate(sets):
        common = Counter(m for x in s for m in holders[x] if m < n)
        edges += [(m, n) for m, c in common.items() if 100 * c >= similarity * (len(s) + len(sets[m]) - c)]
    return {i: ids[r] for i, r in zip(ids, roots(len(ids), edges))}


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
