"""Web archives with a two-level capture index.

Pages are sorted by reversed-host URL key over all tasks; each task writes one archive of
gzip members and, beside it, its part of the capture index as compressed blocks of sorted
lines. Only one row per block, its first key and place, goes to the sparse directory, a
table. A lookup binary-searches the directory, reads one block by its byte range,
binary-searches its lines, and reads one archive member by its range. Payloads that occur
more than once are stored once: the capture with the largest id is the response, the others
are revisits that name it.

Files are written under a name of the task attempt and then renamed, so a task that runs
again leaves the same files. The folder must be one that all executors see.

Cases: a null payload is empty; a null URL has the empty key; a null id is the smallest, so
it is a response only if no other capture has its payload; equal rows, and rows with the same id and
payload, are all responses if that id is the largest; empty tables give an empty directory; a URL
with several captures gives them all; other columns are not archived.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm.text import input_bytes
from lingweave.session import stored

DATE = "2000-01-01T00:00:00Z"  # the pages carry no capture time
LEAST_REVISIT = 0  # bytes of a payload that may be a revisit
BLOCK_LINES = 256  # captures of an index block
DIRECTORY_ROWS = 200_000  # directory rows sent to tasks at once
SENT_DIGESTS = 200_000  # repeated digests sent to every task, some 20 MB; more are joined
ARCHIVE_BYTES = 64 << 20  # input of one archive

DIRECTORY = "first_key string, last_key string, file string, start bigint, length bigint, captures bigint"
CAPTURE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: Column) -> Column:
    """Host reversed at its dots, then the rest: captures of a domain stand together."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    return F.when(url.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(url)


def record_types(pages: DataFrame, page_id: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``_refers_to``: null for a response, else the id of the response with the same payload."""
    body = F.coalesce(F.col(payload), F.lit(""))
    pages = pages.withColumn("_sha1", F.sha1(body))
    long_enough = F.octet_length(body) >= least
    # digests that occur once need no row here
    best = pages.where(long_enough).groupBy("_sha1").agg(F.max(page_id).alias("_best"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    best = stored(best, "warc-repeated")
    # repeated digests are few; where they are not, both sides are dealt by digest
    joined = pages.join(F.broadcast(best) if best.count() <= SENT_DIGESTS else best, "_sha1", "left")
    return joined.withColumn(
        "_refers_to", F.when(long_enough & F.col("_best").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_best")), F.col("_best"))
    ).drop("_best", "_sha1")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and drops the payload."""
    name = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {name}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%-._~ "),
        "WARC-Payload-Digest": f"sha1:{name}",
        "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "X-Page-Id": page_id,
        "X-Refers-To-Page": refers_to,
        "X-Url": None if url is None else json.dumps(url),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple:
    """The fields of ``CAPTURE`` from one record; a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
    name, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    number = lambda k: int(fields[k]) if k in fields else None
    url = json.loads(fields["X-Url"]) if "X-Url" in fields else None
    return number("X-Page-Id"), url, size, name, kind, number("X-Refers-To-Page"), payload if kind == "response" else None


class _Writer:
    """One archive and its part of the capture index."""

    def __init__(self, folder: str, part: int, attempt: int, block_lines: int):
        self.files, base = filesystem(folder)
        self.base, self.part, self.attempt, self.block_lines = base, part, attempt, block_lines
        self.archive = self.files.open_output_stream(self._path("warc.gz", True))
        self.index = self.files.open_output_stream(self._path("cdx", True))
        self.lines: list[str] = []
        self.rows: list[tuple] = []

    def _path(self, kind: str, draft: bool) -> str:
        return f"{self.base}/part-{self.part:05d}.{kind}{f'.{self.attempt}' if draft else ''}"

    def add(self, key: str, record: bytes) -> None:
        start = self.archive.tell()
        member = gzip.compress(record, 6, mtime=0)
        self.archive.write(member)
        self.lines.append(f"{json.dumps(key)}\t{start}\t{len(member)}")
        if len(self.lines) == self.block_lines:
            self.flush()

    def flush(self) -> None:
        if not self.lines:
            return
        start, block = self.index.tell(), zlib.compress("\n".join(self.lines).encode(), 6)
        self.index.write(block)
        keys = [json.loads(self.lines[i].partition("\t")[0]) for i in (0, -1)]
        self.rows.append((*keys, f"part-{self.part:05d}", start, len(block), len(self.lines)))
        self.lines = []

    def close(self) -> list[tuple]:
        self.flush()
        for stream, kind in ((self.archive, "warc.gz"), (self.index, "cdx")):
            stream.close()
            self.files.move(self._path(kind, True), self._path(kind, False))
        return self.rows


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Write archives and index blocks to ``folder``; returns the sparse directory, stored there too."""
    spark = pages.sparkSession
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    typed = record_types(rows, "page_id", "payload", least).withColumn("_key", url_key(F.col("url")))
    parts = max(spark.sparkContext.defaultParallelism, (input_bytes(pages) or 0) // ARCHIVE_BYTES)
    ranged = typed.select("_key", "page_id", "url", "payload", "_refers_to").repartitionByRange(parts, "_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = None
        for batch in batches:
            for key, number, address, text, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    writer = _Writer(folder, task.partitionId(), task.taskAttemptId(), block_lines)
                writer.add(key, archive_record(number, address, (text or "").encode("utf-8", "surrogatepass"), refers))
        made = writer.close() if writer else []
        names = [f.split(" ")[0] for f in DIRECTORY.split(", ")]
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names)

    directory = ranged.sortWithinPartitions("_key", "page_id").mapInArrow(run, DIRECTORY)
    directory.write.mode("overwrite").parquet(f"{folder}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def _block(files: fs.FileSystem, base: str, file: str, start: int, length: int) -> list[tuple[str, int, int]]:
    """The captures of an index block: key, start and length of the archive member."""
    with files.open_input_file(f"{base}/{file}.cdx") as index:
        data = zlib.decompress(index.read_at(length, start)).decode()
    return [(json.loads(k), int(s), int(n)) for k, s, n in (line.split("\t") for line in data.split("\n"))]


def _captures(rows: list[tuple], extra: list[list] = (), names: tuple[str, ...] = ()) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*extra, *columns], [*names, *(f.split(" ")[0] for f in CAPTURE.split(", "))])


def read_archives(directory: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All captures, block by block of the directory; one range read per capture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for file, start, length in zip(*[c.to_pylist() for c in batch.columns]):
                found = []
                with files.open_input_file(f"{base}/{file}.warc.gz") as archive:
                    for _, at, size in _block(files, base, file, start, length):
                        record = read_record(gzip.decompress(archive.read_at(size, at)))
                        found.append(record if payloads else (*record[:-1], None))
                yield _captures(found)

    blocks = directory.select("file", "start", "length")
    parts = directory.sparkSession.sparkContext.defaultParallelism * 4
    return blocks.repartition(parts).mapInArrow(run, CAPTURE)


def lookup(urls: DataFrame, directory: DataFrame, folder: str, url: str = "url", most: int = DIRECTORY_ROWS) -> DataFrame:
    """Captures of the given URLs: directory search, block read, line search, member read.

    The directory is sent to tasks in slices of about ``most`` rows, chosen by a hash of the
    block; every slice is searched for all URLs, and blocks do not overlap but at their borders.
    """
    count = directory.count()
    slices = max(1, -(-count // most))
    wanted = urls.select(F.col(url).alias("wanted")).where("wanted is not null").distinct().withColumn("_key", url_key(F.col("wanted")))
    if slices == 1:
        return _lookup(wanted, directory, folder)
    cuts = [r[0] for r in directory.select(F.percentile_approx(F.xxhash64("file", "start"), [i / slices for i in range(1, slices)]).alias("c")).collect()][0]
    name, found = F.xxhash64("file", "start"), None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = directory.where((F.lit(low is None) | (name > F.lit(low))) & (F.lit(high is None) | (name <= F.lit(high))))
        one = _lookup(wanted, part, folder)
        found = one if found is None else found.unionByName(one)
    return found


def _lookup(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    rows = sorted((r.first_key, r.last_key, r.file, r.start, r.length) for r in directory.collect())
    shared = wanted.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        rows = shared.value
        firsts = [r[0] for r in rows]
        for batch in batches:
            names, found = [], []
            for name, key in zip(*[c.to_pylist() for c in batch.columns]):
                # blocks are sorted and do not overlap but for equal keys at their borders
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and rows[at][1] >= key:
                    _, _, file, start, length = rows[at]
                    lines = _block(files, base, file, start, length)
                    keys = [line[0] for line in lines]
                    for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                        with files.open_input_file(f"{base}/{file}.warc.gz") as archive:
                            record = read_record(gzip.decompress(archive.read_at(line[2], line[1])))
                        if record[1] == name:
                            names.append(name), found.append(record)
                    at -= 1
            yield _captures(found, [pa.array(names, pa.string())], ("wanted",))

    return wanted.mapInArrow(run, f"wanted string, {CAPTURE}")
