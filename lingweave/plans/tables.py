"""The stored tables in the roles the queries need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lingweave.functions.clean import clean_text, clean_text_alpha
from lingweave.session import spread

SEED = 42
VOCAB_SIZE = 2000
VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a ready byte-level vocabulary of 50,000 merges


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_of(source: Column) -> Column:
    """Sources 0..15 train, 16 and 17 validate, the others test."""
    number = F.substring(source, 4, 10).cast("int")
    return F.when(number < 16, "train").when(number < 18, "validation").otherwise("test")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text, lang, source, split``."""
    table = spread(read(spark, sf, "documents"), "doc_id")
    return table.select("doc_id", "text", "lang", "source", split_of(F.col("source")).alias("split"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, hi_en, en, source``: a user turn and the assistant turn that follows.

    Turns alternate, so the answer to turn n is turn n + 1. The equi-join on
    conversation and turn has no hot key, unlike a window over a conversation.
    """
    turns = spread(read(spark, sf, "conversations"), "conv_id", "turn")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("hi_en"), (F.col("turn") + 1).alias("next")
    )
    answer = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("en"))
    return asked.join(answer, ["conv_id", "next"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"),
        "hi_en",
        "en",
        F.concat(F.lit("c"), F.col("conv_id") % 4).alias("source"),
    )


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """``origin, id, source, text``: documents dressed up as posts, and raw pages with their URL.

    The decoration puts a match for every cleaning rule on every document.
    """
    posts = docs(spark, sf).select(
        F.lit("doc").alias("origin"),
        F.col("doc_id").alias("id"),
        "source",
        F.concat(
            F.lit("<user> RT : "), "text", F.lit(" #"), "lang", F.lit(" @"), "source", F.lit(" \U0001f445  ok!!")
        ).alias("text"),
    )
    pages = spread(read(spark, sf, "pages"), "page_id").select(
        F.lit("page").alias("origin"),
        F.col("page_id").alias("id"),
        F.lit("pages").alias("source"),
        F.concat("url", F.lit(" "), "html").alias("text"),
    )
    return posts.unionByName(pages)


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, source, ref, hyp``: cleaned text against its letters-only form."""
    text = F.col("text")
    return docs(spark, sf).select(
        "doc_id", "source", clean_text(text).alias("ref"), clean_text_alpha(text).alias("hyp")
    )


def systems(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, source, ref, letters, raw``: one reference and the texts of two systems."""
    text = F.col("text")
    return docs(spark, sf).select(
        "doc_id", "source", clean_text(text).alias("ref"), clean_text_alpha(text).alias("letters"), text.alias("raw")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "embedding")


def vector_ids(tokens: Column, count: int) -> Column:
    """The vector of each token, by hash."""
    return F.transform(
        tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % count).cast("int")
    )
