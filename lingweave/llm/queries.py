"""The registered queries of the training-data operators."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lingweave.llm import align, chat, decontaminate as dc, extract, language, lines, lm, merkle, near, pieces, quality, tokens, warc
from lingweave.session import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontaminate(spark, sf):
    """Hit words and items of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = dc.judge(docs, table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op9_near_duplicates(spark, sf):
    """Component of near copies of every document."""
    return near.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op2_language(spark, sf):
    """Predicted language of every document, learnt from three quarters of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs).withColumn("held_out", language.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality(spark, sf):
    """Counts and verdict of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.rate(docs, table(spark, sf, "labels")).drop("text")


@query
def op5_lm_score(spark, sf):
    """Base score and lattice score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = lm.held_out(F.col("doc_id"))
    found = lm.score(docs, ~held).withColumn("held_out", held)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_chat_format(spark, sf):
    """Digests of all conversations, read back from their stored formatted turns."""
    said = "\\### Assistant: </turn> ok"
    messages = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    extra = spark.createDataFrame([(-7, messages)], "conv_id bigint, record string")
    records = chat.conversations(table(spark, sf, "conversations")).unionByName(extra)
    formatted = stored(chat.format_turns(chat.canonical_turns(records)), "chat")
    return chat.digests(formatted)


@query
def op7_token_counts(spark, sf):
    """Tokens of every document and of each of its lines."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).drop("text")


@query
def op10_warc(spark, sf):
    """All pages archived, indexed and read back."""
    folder = scratch_path(spark, "warc")
    directory = warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(directory, folder, payloads=False).drop("url", "payload")


@query
def op3_html_text(spark, sf):
    """Main text of every page."""
    return extract.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_pieces(spark, sf):
    """Pieces of every document, and whether they give its text back."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pieces.encode(docs, decoded="decoded")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), ids.alias("ids_sha256"), pieces.same_text("text", "decoded").alias("round_trip"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7  # documents whose id's checksum is a multiple of it are changed after the manifest


@query
def op11_manifest(spark, sf):
    """Leaf, roots and proof of every document, checked against a copy with some rows changed."""
    docs = table(spark, sf, "documents").select(*FIELDS)
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, merkle.leaf_digest(changed))
    manifest = merkle.build(docs, "lang", ["doc_id"], merkle.leaf_digest([F.col(c) for c in FIELDS]), {"doc_id": F.col("doc_id"), "tampered": tampered})
    found = merkle.proofs(manifest)
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_line_dedup(spark, sf):
    """Every document without the lines that other documents hold."""
    found = lines.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_alignment(spark, sf):
    """Groups and links of both tokenizers in every document."""
    found = align.align(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
