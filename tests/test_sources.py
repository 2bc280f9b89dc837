"""Readers and writers on files with every irregularity they must handle."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lingweave.session import scratch_path, shared_dir, stored
from lingweave.sources import corpus, pairs as P

HEADER = ["en_query", "cs_query", "domain"]


def write(tmp_path: Path, name: str, text: str) -> str:
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ragged_tsv(spark, tmp_path):
    records = [
        "\t".join(HEADER),
        "a\tb\tc",
        "two\tfields",
        '"q\t1"\tq2\tq3',
        '"first\nsecond"\tline\tx',
        '"say ""hi"""\tz\tz',
        'open "mid\tm\tm',
        "short",
        "",
        "four\tfields\tare\tskipped",
        "four\tempty\tlast\t",
        "five\twith\tempty\t\tfourth",
        "no second\t\tx",
        "NA\tmissing\tx",
        "missing\tnull\tx",
    ]
    path = write(tmp_path, "train.tsv", "\n".join(records) + "\n")
    got = P.read_tsv_pairs(spark, [path], HEADER, "queries", multiline=True).drop("ordinal").collect()
    assert {tuple(r) for r in got} == {
        ("b", "a", "queries"),
        ("fields", "two", "queries"),
        ("q2", "q\t1", "queries"),
        ("line", "first\nsecond", "queries"),
        ("z", 'say "hi"', "queries"),
        ("m", 'open "mid', "queries"),
    }


def test_tsv_projection_does_not_hide_bad_rows(spark, tmp_path):
    path = write(tmp_path, "t.tsv", "en_query\tcs_query\tdomain\na\tb\tc\nw\tx\ty\tz\n")
    df = P.read_tsv_pairs(spark, [path], HEADER, "queries")
    assert df.count() == 1
    assert [r[0] for r in df.select("en").collect()] == ["a"]


def test_files_keep_their_order(spark, tmp_path):
    files = [
        write(tmp_path, f"{name}.tsv", "en_query\tcs_query\tdomain\n" + "".join(f"{name}{i}\tx\ty\n" for i in range(3)))
        for name in ("z", "a")
    ]
    got = P.read_tsv_pairs(spark, files, HEADER, "queries").orderBy("ordinal").collect()
    assert [r["en"] for r in got] == ["z0", "z1", "z2", "a0", "a1", "a2"]


def test_order_of_paths_with_equal_ends_blanks_and_folders(spark, tmp_path):
    head = "en_query\tcs_query\tdomain\n"
    for folder in ("y/x", "x", "a b", "part"):
        (tmp_path / folder).mkdir(parents=True)
    first = write(tmp_path, "y/x/t.tsv", head + "one\tx\ty\n")
    second = write(tmp_path, "x/t.tsv", head + "two\tx\ty\n")
    third = write(tmp_path, "a b/t.tsv", head + "three\tx\ty\n")
    write(tmp_path, "part/t.tsv", head + "four\tx\ty\n")
    files = [first, second, third, str(tmp_path / "part")]
    for order in (files, files[::-1]):
        got = P.read_tsv_pairs(spark, order, HEADER, "q").orderBy("ordinal").collect()
        assert [r["en"] for r in got] == [dict(zip(files, ("one", "two", "three", "four")))[f] for f in order]


def test_short_lines(spark, tmp_path):
    path = write(tmp_path, "s.txt", "hello\tnamaste\nshort\n\n")
    assert [r["en"] for r in P.read_line_pairs(spark, [path], "lines").collect()] == ["hello"]
    with pytest.raises(Exception, match="exactly two fields"):
        P.read_line_pairs(spark, [path], "lines", strict=True).collect()


def test_lines(spark, tmp_path):
    good = write(tmp_path, "dev.txt", "hello\tnamaste\nbye \t alvida\n")
    got = P.load_splits(lambda f: P.read_line_pairs(spark, f, "lines"), {"validation": [good], "other": ["x"]})
    assert {tuple(r) for r in got.drop("ordinal").collect()} == {
        ("namaste", "hello", "lines", "validation"),
        (" alvida", "bye ", "lines", "validation"),
    }
    bad = write(tmp_path, "bad.txt", "one\ttwo\tthree\n")
    with pytest.raises(Exception, match="exactly two fields"):
        P.read_line_pairs(spark, [bad], "lines").collect()


def test_nested_struct_map_and_json(spark, tmp_path):
    struct = spark.sql("select named_struct('en', 'a', 'hi_en', 'b') as translation, 'test' as split")
    mapped = spark.sql("select map('en', 'c', 'hi_ng', 'd') as translation union all select map('en', 'e')")
    first = P.extract_translation(struct, ("en", "hi_en"), "one")
    second = P.extract_translation(mapped, ("en", "hi_ng"), "two")
    merged = P.merge_sources({"one": first, "two": second})
    got = {(r["hi_en"], r["en"], r["source"], r["split"], r["dataset_ord"]) for r in merged.collect()}
    assert got == {("b", "a", "one", "test", 0), ("d", "c", "two", None, 1), (None, "e", "two", None, 1)}
    path = write(tmp_path, "n.json", '{"translation": {"en": "x", "hi_en": "y"}}\n')
    row = P.load_nested(spark, path, ("en", "hi_en"), "json", fmt="json").first()
    assert (row["hi_en"], row["en"], row["split"]) == ("y", "x", "train")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_corpus_overwrite_and_reuse(spark, tmp_path, fmt):
    path = str(tmp_path / "corpus")
    schema = "hi_en string, en string, source string, split string"
    rows = lambda tag: spark.createDataFrame(
        [(f'{tag} "q"\nx', "e,n", "s", "train"), (tag, "en", "s", "test")], schema
    )
    read = lambda: {tuple(r) for r in corpus.read_corpus(spark, path, schema, fmt).collect()}
    corpus.write_corpus(rows("one"), path, fmt=fmt)
    first = read()
    assert first == {tuple(r) for r in rows("one").collect()}
    corpus.write_corpus(rows("two"), path, remove=False, fmt=fmt)
    assert read() == first
    corpus.write_corpus(rows("two"), path, fmt=fmt)
    assert read() == {tuple(r) for r in rows("two").collect()}


def test_split_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.write_corpus(spark.createDataFrame([("a", "train"), ("b", "test")], "en string, split string"), path)
    plan = corpus.read_corpus(spark, path).where("split = 'test'").select("en")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in text and "ReadSchema: struct<en:string>" in text


def test_answer_log(spark, tmp_path):
    path = str(tmp_path / "log")
    answers = [(1, "a\nb "), (2, " c\td"), (3, "")]
    df = spark.createDataFrame(answers, "row_id long, answer string")
    corpus.append_answers(df.where("row_id < 2"), path, "answer")
    corpus.append_answers(df.where("row_id >= 2"), path, "answer")
    assert {tuple(r) for r in corpus.read_answers(spark, path, "long").collect()} == {(1, "ab"), (2, "c\td"), (3, "")}


def test_predictions_csv(spark, tmp_path):
    path = str(tmp_path / "preds")
    df = spark.createDataFrame([("a,b", 'c "d"')], "hi_en string, preds string")
    corpus.write_predictions(df, path)
    assert spark.read.csv(path, header=True, escape='"').first()[:] == ("a,b", 'c "d"')


def test_shared_folder_must_be_named():
    class Context:
        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_shared_folder_holds_stored_tables(spark):
    base = shared_dir(spark)
    assert scratch_path(spark, "x").startswith(base)
    df = stored(spark.range(5).withColumn("t", F.lit("v")))
    assert df.count() == 5 and df.inputFiles()[0].split("://")[-1].removeprefix("file:").startswith(base)


def test_repeated_append_replaces_its_run(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "one"), (2, "two\nlines")], "row_id long, a string")
    corpus.append_answers(rows.limit(1), path, "a", run="first")
    corpus.append_answers(rows, path, "a", run="first")
    corpus.append_answers(rows.where("row_id = 2"), path, "a")
    got = sorted(map(tuple, corpus.read_answers(spark, path, "long").collect()))
    assert got == [(1, "one"), (2, "twolines"), (2, "twolines")]
