"""Main text of web pages by differencing with the page of the nearest URL, guided by structure.

A page becomes text lines, one per block, each with its structural role. Pages of a host are
ordered by URL path; a page is paired with the neighbour that shares the longer path prefix.
The lines of both are aligned by a longest common subsequence, and the lines of the page that the
neighbour shares are deleted. Two rules complete it, since differencing alone is wrong in
both directions: lines inside the element that the page declares as its article are text even if
a neighbour repeats them, and lines of elements that the page declares as navigation, form,
advert, notice or comment go even if no neighbour has them. On a page without a declared
article, differencing decides.

Only line hashes travel between pages. The order over all hosts is one range sort of keys, so
a host with a third of all pages spreads over tasks.

Cases: null or empty HTML gives an empty text; a null URL is a host of its own; a page
alone on its host loses no shared line; pages of a host with equal lines are copies, get the
same text, and are not each other's neighbour: all are compared with one page that differs; pages
whose lines are all shared keep those outside chrome; unclosed tags, comments and quotes end with their parent or the page; empty tables give
no rows; input columns named like an output are replaced; long pages are aligned whole.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm.text import add_columns
from lingweave.operators.indexing import row_index
from lingweave.session import stored

# Elements whose contents are not text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title".split())
# Elements that never hold main text.
CHROME = frozenset("head nav footer aside form button select menu dialog label input".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# Words of class, id and role attributes that mark chrome.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead toolbar topbar header share sharing social newsletter "
    "subscribe signup login search related recommended widget widgets comment comments reply replies respond discussion disqus complementary contentinfo".split()
)
# An item end or block start that closes an open element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("body div section article main nav aside header footer form table ul ol dl blockquote td th li figure".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)/?(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

ADDED = "text string, n_chars bigint"


@dataclass
class Line:
    """A block of text and where it stands."""

    text: str
    main: bool  # inside the declared article
    chrome: bool  # inside an element that never holds main text


def marks_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_main):
        return True
    if tag in MAIN and not re.search("comment", attributes, re.I) or tag in ("body", "html"):
        return False
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    words = {w for m in _NAMES.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return not words.isdisjoint(CHROME_WORDS)


def lines(page: str) -> list[Line]:
    """Text blocks of a page in order."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # tag, inside the article, inside chrome

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Line(text, *stack[-1][1:]))

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if not tag:
            parts.append(page[at:])
            break
        parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            end_block()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # an inline end tag does not close the block around it
            if depth and (name not in INLINE or all(s[0] in INLINE for s in stack[depth:])):
                del stack[depth:]
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        shut = CLOSES.get(name, set()) if name in CLOSES else {"p"}
        if name not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut or (name in CLOSES and stack[i][0] == "p"):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        main, chrome = stack[-1][1] or name in MAIN, stack[-1][2]
        if not chrome and name not in INLINE:
            chrome = marks_chrome(name, attributes, stack[-1][1])
        stack.append((name, main and not chrome, chrome))
    end_block()
    return out


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other``.

    Equal ends are matched first; the rest is the longest rising run of matching positions.
    """
    low, high, other_high = 0, len(own), len(other)
    while low < min(high, other_high) and own[low] == other[low]:
        low += 1
    while high > low and other_high > low and own[high - 1] == other[other_high - 1]:
        high, other_high = high - 1, other_high - 1
    shared = {*range(low), *range(high, len(own))}
    places: dict[int, list[int]] = {}
    for j in range(other_high - 1, low - 1, -1):
        places.setdefault(other[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, object]] = []
    for i in range(low, high):
        for j in places.get(own[i], ()):
            k = bisect.bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j), nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        shared.add(node[0])
        node = node[1]
    return shared


def main_text(page: str, neighbour: list[int] | None) -> str:
    """Blocks that are neither chrome nor shared, but always those of the declared article."""
    found = lines(page)
    declared = any(x.main for x in found)
    if declared:
        kept = [x for x in found if x.main and not x.chrome]
    else:
        shared = common_lines([line_hash(x.text) for x in found], neighbour) if neighbour else set()
        text = [(i, x) for i, x in enumerate(found) if not x.chrome]
        # where the neighbour has all of the text, differencing says nothing
        kept = [x for i, x in text if i not in shared] or [x for _, x in text]
    return "\n".join(x.text for x in kept)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, without query and fragment."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    return F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def prefix_length(a: Column, b: Column) -> Column:
    """Number of leading path segments that are equal."""
    pairs = F.arrays_zip(F.split(a, "/").alias("a"), F.split(b, "/").alias("b"))
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))

    def add(s: Column, p: Column) -> Column:
        same = s["same"] & p["a"].eqNullSafe(p["b"])
        return F.struct((s["n"] + same.cast("int")).alias("n"), same.alias("same"))

    return F.aggregate(pairs, state, add)["n"]


def neighbours(pages: DataFrame) -> DataFrame:
    """``_page, _other``: line hashes of the nearest page on the same host that differs, for distinct pages.

    Copies stand in the order once, at the place of the first of them, and share its neighbour.
    """

    def make() -> Callable:
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            at = batch.schema.get_field_index("html")
            hashes = [[line_hash(x.text) for x in lines(page or "")] for page in batch.column(at).to_pylist()]
            return [pa.array(hashes, pa.list_(pa.int64()))]

        return columns

    host, path = url_parts(F.col("url"))
    hashed = add_columns(pages.select("_page", "url", "html"), "_lines array<bigint>", make)
    copies = F.xxhash64("_lines", F.size("_lines")).alias("_copies")
    keyed = hashed.select("_page", host.alias("_host"), path.alias("_path"), "_lines", copies).dropDuplicates(["_page"])
    keyed = stored(keyed, "page-lines")
    light = keyed.drop("_lines")
    first = light.groupBy("_host", "_copies").agg(F.min(F.struct("_path", "_page")).alias("_first"))
    placed = row_index(first.select("_host", "_copies", "_first._path", "_first._page"), ["_host", "_path", "_page"], name="_at")

    def beside(step: int, name: str) -> DataFrame:
        return placed.select((F.col("_at") + step).alias("_at"), F.struct("_host", "_path", "_page").alias(name))

    both = placed.join(beside(1, "_before"), "_at", "left").join(beside(-1, "_after"), "_at", "left")
    near = lambda side: F.when(F.col(side)["_host"] == F.col("_host"), prefix_length(F.col("_path"), F.col(side)["_path"]))
    before, after = F.coalesce(near("_before"), F.lit(-1)), F.coalesce(near("_after"), F.lit(-1))
    chosen = F.when((before < 0) & (after < 0), None).when(before >= after, F.col("_before")["_page"]).otherwise(F.col("_after")["_page"])
    near_lines = keyed.select(F.col("_page").alias("_near"), F.col("_lines").alias("_other"))
    of_copies = both.select("_host", "_copies", chosen.alias("_near")).join(near_lines, "_near").drop("_near")
    return light.select("_page", "_host", "_copies").join(of_copies, ["_host", "_copies"]).select("_page", "_other")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages; the HTML column is dropped."""
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    named = pages.select(*[f"`{c}`" for c in kept], F.xxhash64(page_id, url, page, F.lit(1)).alias("_page"), F.col(page).alias("_html"))
    keys = pages.select(F.xxhash64(page_id, url, page, F.lit(1)).alias("_page"), F.col(url).alias("url"), F.col(page).alias("html"))
    joined = named.join(neighbours(keys), "_page", "left").drop("_page")

    def make() -> Callable:
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            texts = [main_text(p or "", o) for p, o in zip(column("_html"), column("_other"))]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return columns

    return add_columns(joined, ADDED, make).drop("_html", "_other")
