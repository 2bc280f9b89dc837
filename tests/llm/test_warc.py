"""Archives and their index."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from lingweave.llm import warc
from lingweave.session import scratch_path

ROWS = [
    (1, "http://www.a.org/x", "<p>é</p>"),
    (2, "http://www.a.org/x", "<p>other</p>"),
    (3, "https://b.a.org/y?z=1", "<p>é</p>"),
    (4, "http://c.net/", None),
    (5, "http://c.net/", ""),
    (6, None, "no url"),
    (7, "not a url", "x" * 300_000),
    (None, "http://d.net/", "<p>é</p>"),
    (8, "http://e.net/a b\r\nc", "\r\n\r\nWARC/1.1\r\n"),
    (9, "http://f.net/1", "same id"),
    (9, "http://f.net/2", "same id"),
    *[(100 + i, f"http://many.org/{i:03d}", f"page {i}") for i in range(60)],
]


@pytest.fixture(scope="module")
def archive(spark):
    folder = scratch_path(spark, "warc-test")
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    return folder, warc.write_archives(frame, folder, block_lines=4)


def test_everything_reads_back(archive):
    folder, directory = archive
    rows = warc.read_archives(directory, folder).collect()
    best = defaultdict(list)
    for i, _, text in ROWS:
        best[text or ""].append(-1 if i is None else i)
    payload = lambda t: (t or "").encode()
    expected = []
    for i, url, text in ROWS:
        top = max(best[text or ""])
        revisit = top != (-1 if i is None else i)
        name = base64.b32encode(hashlib.sha1(payload(text)).digest()).decode()
        expected.append((i, url, len(payload(text)), name, "revisit" if revisit else "response", top if revisit else None, None if revisit else payload(text)))
    shown = lambda r: sorted(map(repr, r))
    assert shown(tuple(x if not isinstance(x, bytearray) else bytes(x) for x in r) for r in rows) == shown(expected)


@pytest.mark.parametrize("most", [1000, 3])
def test_lookup(spark, archive, most):
    folder, directory = archive
    wanted = ["http://www.a.org/x", "http://many.org/007", "http://many.org/059", "http://nowhere.org/", "http://c.net/", "not a url", None]
    frame = spark.createDataFrame([(u,) for u in wanted], "url string")
    got = sorted((r.wanted, r.page_id) for r in warc.lookup(frame, directory, folder, most=most).collect())
    assert got == sorted((u, i) for i, u, _ in ROWS if u in wanted and u)


def test_directory_is_sparse_and_sorted(archive):
    _, directory = archive
    rows = sorted((r.first_key, r.last_key, r.captures) for r in directory.collect())
    assert sum(r[2] for r in rows) == len(ROWS) and len(rows) < len(ROWS)
    assert all(a[1] <= b[0] for a, b in zip(rows, rows[1:]))


def test_keys(spark):
    urls = ["http://WWW.a.org/x?y#z", "ftp://b.c", "mailto:x", None]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(warc.url_key(frame["url"])).collect()] == ["org,a,www)/x?y#z", "c,b)", "mailto:x", ""]


def test_empty_and_least_size(spark):
    folder = scratch_path(spark, "warc-empty")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    directory = warc.write_archives(empty, folder)
    assert directory.count() == 0 and warc.read_archives(directory, folder).count() == 0
    folder = scratch_path(spark, "warc-small")
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "v", "abcd")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, folder, least=3), folder).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_repeats_are_joined_beyond_the_limit(spark, monkeypatch):
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    both = []
    for limit in (warc.SENT_DIGESTS, 0):
        monkeypatch.setattr(warc, "SENT_DIGESTS", limit)
        both.append(sorted(map(str, warc.record_types(frame, "page_id", "html").collect())))
    assert both[0] == both[1] and len(both[0]) == len(ROWS)


def test_damage_is_noticed():
    record = warc.archive_record(1, "http://a/", b"payload", None)
    assert warc.read_record(record)[-1] == b"payload"
    with pytest.raises(ValueError, match="differ"):
        warc.read_record(record.replace(b"payload", b"paylord"))
    assert gzip.decompress(gzip.compress(record, mtime=0)) == record
