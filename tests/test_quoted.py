"""Records with quoted line breaks against Spark's reader of whole files, for blocks of any size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lingweave.sources import pairs as P
from lingweave.sources.quoted import INSIDE, OUTSIDE, after_line, read_records

HEADER = ["en_query", "cs_query", "domain"]


def content(seed: int, rows: int) -> str:
    rng = random.Random(seed)
    lines = ['en_query\tcs_query\t"do\nmain"']
    for i in range(rows):
        fields = []
        for _ in range(rng.choice([3, 3, 3, 3, 2, 4])):
            kind = rng.randrange(6)
            text = "".join(rng.choice(["ab", 'x "y" z', "\n", "\t", "é", "\n\n", " "]) for _ in range(rng.choice([1, 3, 40 if i % 17 == 0 else 2])))
            if kind < 3:
                fields.append('"' + text.replace('"', '""') + '"')
            else:
                fields.append(f"f{i} " + text.replace("\n", " ").replace("\t", " ") + ('5" pipe' if kind == 4 else ""))
        lines.append("\t".join(fields))
        if rng.randrange(9) == 0:
            lines.append("")
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_equals_the_reader_of_whole_files(spark, tmp_path, block):
    files = []
    for k, rows in enumerate((120, 1, 0, 60)):
        files.append(str(tmp_path / f"f{k}.tsv"))
        (tmp_path / f"f{k}.tsv").write_bytes(content(k, rows).encode())
    fields = ", ".join(f"{c} string" for c in HEADER)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = read_records(spark, files)
        if block < 1 << 20:
            assert spark.read.text(files).rdd.getNumPartitions() > 4
        parsed = records.select(F.from_csv("text", fields, {"sep": "\t", "escape": '"'}).alias("r"), "text", "file", "path", "block", "row")
        got = parsed.orderBy("file", "block", "row").collect()
        read = P.read_tsv_pairs(spark, files, HEADER, "s", multiline=True).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = spark.read.schema(fields).csv(files, sep="\t", header=True, multiLine=True, escape='"').collect()
    assert sorted((tuple(r.r) for r in got), key=repr) == sorted(map(tuple, expected), key=repr)
    # too many fields go, short records stay
    raw = spark.read.option("columnPruning", False).schema(f"{fields}, _extra string, _raw string").csv(files, sep="\t", header=True, multiLine=True, escape='"', columnNameOfCorruptRecord="_raw")
    kept = raw.where(F.col("_raw").isNotNull() & (P._fields_present(F.col("_raw")) <= 3))
    assert read == P.drop_missing(kept, ["en_query", "cs_query"]).count() > 50


def test_open_quote_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b'h\ti\r\n"a\r\nb"\tc\r\nd\t"never closed\nto the end\n\nof the file')
    got = [r.text for r in read_records(spark, [str(tmp_path / "a.tsv")]).orderBy("row").collect()]
    assert got == ['"a\nb"\tc', 'd\t"never closed\nto the end\n\nof the file']
    (tmp_path / "b.tsv").write_bytes(b"")
    assert read_records(spark, [str(tmp_path / "b.tsv")]).count() == 0


@pytest.mark.parametrize(
    "line, if_outside, if_inside",
    [
        ("plain\ttext", OUTSIDE, INSIDE),
        ('"open', INSIDE, OUTSIDE),
        ('"a"\t"b', INSIDE, INSIDE),
        ('a"\tb', OUTSIDE, OUTSIDE),
        ('""\t"', INSIDE, OUTSIDE),
        ('5" pipe', OUTSIDE, OUTSIDE),
        ('"5"" pipe"', OUTSIDE, OUTSIDE),
        ("", OUTSIDE, INSIDE),
    ],
)
def test_steps(line, if_outside, if_inside):
    assert (after_line(line, OUTSIDE), after_line(line, INSIDE)) == (if_outside, if_inside)
