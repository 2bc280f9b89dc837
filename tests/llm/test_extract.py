"""Main text of pages, with and without a declared article."""

from __future__ import annotations

import random

import pytest

from lingweave.llm import extract as ex


def text(page: str, other: str | None = None) -> str:
    return ex.main_text(page, other and [ex.line_hash(x.text) for x in ex.lines(other)])


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad box">Buy</div>
<article class="post"><header><h1>Head&nbsp;line</h1></header><p>One <b>bold<br>line &lt;b&gt;<p>Two<!-- no --></p>
<aside>side</aside><div class="share-bar">Share</div><form>Mail <input></form><ul><li>a<li>b</ul>
<div id="comments"><p>First!</p></div><p hidden>no</p></article><div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def test_article_without_chrome():
    assert text(ARTICLE) == "Head line\nOne bold line <b>\nTwo\na\nb"


def test_article_lines_stay_even_if_shared():
    assert text(ARTICLE, ARTICLE) == text(ARTICLE)


def test_differencing_without_article():
    page = "<div>Site name</div><div><p>{}</p><p>same story</p></div><div>All rights reserved</div>"
    assert text(page.format("first"), page.format("second")) == "first"
    assert text(page.format("first")) == "Site name\nfirst\nsame story\nAll rights reserved"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain &eacute; text", "plain é text"),
        ("<p>a < b & c</p>", "a < b & c"),
        ("<p>open <b>bold", "open bold"),
        ("<p>x</p><script>never closed <p>y", "x"),
        ("<p>x</p><!-- never closed <p>y", "x"),
        ('<p title="a > b">x</p>', "x"),
        ("<p title='broken>x</p><p>y</p>", "x\ny"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<article><p>in</p></article><p>out</p>", "in"),
        ("<main><p>in</p><nav>menu</nav></main>", "in"),
        ("<article class='comment'><p>said</p></article><p>text</p>", "text"),
        ("</div></p>stray<p>x", "stray\nx"),
        ("<p>cut <foot", "cut"),
    ],
)
def test_markup(page, expected):
    assert text(page) == expected


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        shared = sorted(ex.common_lines(a, b))
        assert len(shared) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in shared)


def test_pairs_by_path_within_host(spark):
    page = "<div>top {}</div><p>{}</p>"
    rows = [
        (1, "http://h/a/1", page.format("a", "one")),
        (2, "http://h/a/2?x=1", page.format("a", "two")),
        (3, "http://h/b/1", page.format("b", "three")),
        (4, "http://h/b/2", page.format("b", "four")),
        (5, "http://other/a/1", page.format("a", "five")),
        (6, None, page.format("a", "six")),
        (7, "http://h/a/3", None),
        (8, "http://h/a/3", ""),
        (2, "http://h/a/2?x=1", page.format("a", "two")),
    ]
    frame = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, `x.y` int").repartition(4)
    got = ex.extract(frame).collect()
    assert len(got) == len(rows) and "x.y" in got[0].asDict()
    assert {(r.page_id, r.text) for r in got} == {
        (1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "top a\nfive"), (6, "top a\nsix"), (7, ""), (8, ""),
    }
    assert all(r.n_chars == len(r.text) for r in got)
    assert ex.extract(frame.where("false")).count() == 0


def test_copies_without_article_keep_their_text(spark):
    page = "<nav>menu</nav><div>top</div><p>{}</p><div>bottom</div>"
    story, other = page.format("story"), page.format("other")
    rows = [
        (1, "http://h/a/1", story), (2, "http://h/a/1", story), (3, "http://h/a/2", story), (4, "http://h/b/9", other),
        (5, "http://copies/1", story), (6, "http://copies/2", story), (None, None, story), (7, None, story),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.text) for r in ex.extract(frame).collect()}
    whole = "top\nstory\nbottom"
    assert got == {(1, "story"), (2, "story"), (3, "story"), (4, "other"), (5, whole), (6, whole), (None, whole), (7, whole)}


def test_text_that_a_longer_neighbour_holds_is_kept():
    assert text("<nav>menu</nav><p>one</p>", "<p>one</p><p>two</p>") == "one"


def test_stored_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in ex.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
