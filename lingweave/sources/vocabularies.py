"""Byte-level vocabularies of other tools, read into merges and written back.

A rank file has one token a line, base64 and rank: how often tokens merge is not stored, so the merge
that made a token is found again (:func:`lingweave.operators.bpe.merges_of_tokens`). A tokenizer file (JSON) and a
merge list (text) name the two sides of every merge. All are bounded by the vocabulary and read by the driver.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lingweave.functions.tokens import byte_characters
from lingweave.operators.bpe import FIRST_BYTE, FIRST_MERGE, Merge, merges_of_tokens, token_texts


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file: a local path of the driver, or a URI of any file system that Spark knows."""
    if "://" not in path:
        with open(path, "rb") as stream:
            return stream.read()
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_ranks(spark: SparkSession, path: str) -> list[Merge]:
    """Merges of a rank file: lines ``base64 rank``, tokens of one byte first."""
    lines = [line.split() for line in read_bytes(spark, path).splitlines() if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in lines)
    return merges_of_tokens([token for _, token in ranked])


def read_tokenizer(spark: SparkSession, path: str) -> list[Merge]:
    """Merges of a tokenizers file whose model is a byte-level BPE."""
    model = json.loads(read_bytes(spark, path))["model"]
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path}: not a byte-level BPE")
    return _named(m if isinstance(m, list) else m.split(" ") for m in model["merges"])


def read_merge_list(spark: SparkSession, path: str) -> list[Merge]:
    """Merges of a text file ``left right`` a line; a first line with ``#version`` is skipped."""
    lines = read_bytes(spark, path).decode().split("\n")
    return _named(line.split(" ") for line in lines if line and not line.startswith("#version"))


def _named(pairs: Iterable[Sequence[str]]) -> list[Merge]:
    ids = {ch: FIRST_BYTE + i for i, ch in enumerate(sorted(byte_characters()))}
    merges: list[Merge] = []
    for left, right in pairs:
        if left + right in ids:
            raise ValueError(f"two merges make the token {left + right}")
        merges.append(Merge(len(merges), ids[left], ids[right]))
        ids[left + right] = FIRST_MERGE + len(merges) - 1
    return merges


def write_merge_list(merges: Sequence[Merge], spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """One text file ``left right`` a line below ``path``, in rank order."""
    texts = sorted(byte_characters()) + token_texts(merges)
    lines = [(f"{texts[m.left - FIRST_BYTE]} {texts[m.right - FIRST_BYTE]}",) for m in merges]
    _one_file(spark, [("#version: 0.2",), *lines]).write.mode(mode).text(path)


def write_ranks(merges: Sequence[Merge], spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """One text file ``base64 rank`` a line below ``path``: the bytes in the order of their characters, then the merges."""
    value = {ch: b for b, ch in enumerate(byte_characters())}
    texts = sorted(byte_characters()) + token_texts(merges)
    tokens = [base64.b64encode(bytes(value[c] for c in t)).decode() for t in texts]
    _one_file(spark, [(f"{t} {i}",) for i, t in enumerate(tokens)]).write.mode(mode).text(path)


def _one_file(spark: SparkSession, rows: list[tuple[str]]) -> DataFrame:
    return spark.createDataFrame(rows, "line string").coalesce(1)
