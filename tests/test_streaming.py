"""Streams give the rows the batch jobs give."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingweave.functions.whitespace import ws_tokens
from lingweave.operators import cleaning, dedupe, vocab
from lingweave.streaming import jobs

SCHEMA = "hi_en string, en string, ts timestamp"


def feed(spark, folder):
    """Three files, so three micro-batches with one file each."""
    rows = [
        [("Kal!! kya", "What", 0), ("ok", "fine", 1)],
        [("Kal!! kya", "What", 2), ("naya  din", "new day", 3)],
        [("ok", "fine", 4), ("leak", "held out", 5), (None, "x", 6)],
    ]
    flat = []
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "hi_en string, en string, s long").select(
            "hi_en", "en", F.timestamp_seconds("s").alias("ts")
        )
        df.coalesce(1).write.mode("append").parquet(folder)
        flat += part
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, spark.read.schema(SCHEMA).parquet(folder)


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_clean_stream_equals_batch(spark, tmp_path):
    stream, batch = feed(spark, str(tmp_path / "in"))
    held_out = spark.createDataFrame([("leak", "held out")], "hi_en string, en string")
    keys = ["hi_en", "en"]
    for name, event_time in (("plain", None), ("timed", "ts")):
        out = str(tmp_path / name)
        cleaned = jobs.clean_stream(stream, keys, keys, held_out, event_time)
        run(cleaned.writeStream.format("parquet").option("path", out), str(tmp_path / f"c-{name}"))
        got = {tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).select(*keys).collect()}
        kept = dedupe.remove_leaks(dedupe.keep_first(batch, keys, ["ts"]), held_out, keys)
        expected = [tuple(r) for r in cleaning.clean_columns(kept, keys).select(*keys).collect()]
        assert got == set(expected) and spark.read.parquet(out).count() == len(expected)


def test_word_counts_stay_in_few_folders(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "freq")
    for i in range(13):
        spark.createDataFrame([(f"every w{i % 3} word{i}", "x")], "hi_en string, en string").withColumn("ts", F.timestamp_seconds(F.lit(i))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    writer = jobs.word_freq_stream(stream, ws_tokens(F.col("hi_en")), out, every=3)
    run(writer, str(tmp_path / "c"))
    upto, batches = jobs._folders(spark, out)
    assert upto >= 9 and len(batches) <= 4 and len(jobs._names(spark, out)) <= 5
    expected = sorted(map(tuple, vocab.word_freq(spark.read.parquet(folder), ws_tokens(F.col("hi_en"))).collect()))
    shown = lambda: sorted(map(tuple, jobs.read_word_freq(spark, out).collect()))
    assert shown() == expected
    # a compaction that stopped before its table was whole, and one that stopped before it deleted
    some = spark.createDataFrame([("every", 99)], "word string, freq long")
    some.write.parquet(f"{out}/upto=12")
    (tmp_path / "freq" / "upto=12" / "_SUCCESS").unlink()
    some.write.parquet(f"{out}/batch=2")
    assert shown() == expected
    jobs.compact_word_freq(spark, out, 12)
    assert shown() == expected and jobs._names(spark, out) == ["upto=12"]
    # a batch that runs again counts once
    jobs.compact_word_freq(spark, out, 12)
    assert shown() == expected


def test_no_counts_yet(spark, tmp_path):
    assert jobs.read_word_freq(spark, str(tmp_path / "none")).count() == 0


def test_word_freq_stream_equals_batch(spark, tmp_path):
    stream, batch = feed(spark, str(tmp_path / "in"))
    out = str(tmp_path / "freq")
    run(jobs.word_freq_stream(stream, ws_tokens(F.col("hi_en")), out), str(tmp_path / "c"))
    expected = vocab.word_freq(batch, ws_tokens(F.col("hi_en")))
    got = jobs.read_word_freq(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
