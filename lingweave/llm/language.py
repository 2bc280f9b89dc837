"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to a fixed number of buckets. Document
frequencies are counted over all training documents; the weights are fitted on a bounded
sample of them by follow-the-regularised-leader with elastic-net penalties, and a
temperature is fitted on the part of the sample that training did not see. The model has a
fixed size and is sent to the tasks, which score whole texts; nothing else moves.

Cases: a text that is null or has no letter gets ``und`` and score 0, and so does every
text when no document is labelled; rows without text or language teach nothing; repeated
rows and repeated ids are scored alike; empty tables give no rows; input columns named like
an output are replaced. Text length does not matter: a text is one vector of counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm.features import in_order, nonzero, pack, sample, softmax, unit, unpack
from lingweave.llm.text import add_columns

BUCKETS = 1 << 15
SAMPLE_ROWS = 3000  # labelled rows that the classifier is fitted on, about
UNKNOWN = "und"
CALIBRATION_PART = 5  # one sampled row in this many sets the temperature

ADDED = "lang_pred string, score double"


def letter_table() -> np.ndarray:
    """Per code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str, letters: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every n-gram of one to three characters; all but letters count as a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letters[points], points, np.uint32(32))
    blank = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # runs of blanks become one
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    letter = points != 32
    shift = np.uint32(32 - int(np.log2(buckets)))
    mixed = [points * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]

    def bucket(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint32(15)
        return h * np.uint32(0x2C1B3C6D) >> shift

    one = bucket(mixed[0] + np.uint32(1))[letter]
    two = bucket(mixed[0][:-1] + mixed[1][1:] + np.uint32(2))[letter[:-1] | letter[1:]]
    three = bucket(mixed[0][:-2] + mixed[1][1:-1] + mixed[2][2:] + np.uint32(3))[letter[1:-1]]
    return np.concatenate([one, two, three])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf[at])

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias


def document_frequencies(rows: DataFrame, text: str, buckets: int) -> tuple[int, np.ndarray]:
    """Number of texts and, by bucket, the number of texts that hold it; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, n = letter_table(), np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at, _ = nonzero(ngrams(value, letters, buckets), buckets)
                total[at] += 1
                n += 1
        total[buckets] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = rows.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets + 1, np.int64)
    for bucket, n in counts.collect():  # at most one row per bucket
        found[bucket] = n
    return int(found[buckets]), found[:buckets]


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    buckets: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, one row at a time; returns sparse weights and a bias.

    A coordinate whose summed gradient stays below ``l1`` is exactly 0.
    """
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pulled = np.sign(z) * l1 - z
        return np.where(np.abs(z) > l1, pulled / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, buckets), np.append(x, 0.1)  # the last coordinate is the bias
            w = leader(z[at], n[at])
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            before = n[at]
            n[at] = after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
    w = leader(z, n)
    return w[:buckets], w[buckets] * 0.1


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, by a search on a fixed grid that is refined.

    Targets are softened by the rule of succession, so separable rows do not give scores of 1.
    """
    if not len(labels):
        return 1.0
    right = (len(labels) + 1) / (len(labels) + 2)
    target = np.full(logits.shape, (1 - right) / max(1, logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = right
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(4):
        grid = np.linspace(low, high, 41)
        loss = [-(target * np.log(softmax(logits / np.exp(t)) + 1e-12)).sum(1).mean() for t in grid]
        best = int(np.argmin(loss))
        low, high = grid[max(0, best - 1)], grid[min(40, best + 1)]
    return float(np.exp((low + high) / 2))


def train(rows: DataFrame, key: str, text: str = "text", lang: str = "lang", most: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """Fit a model on rows with text and language; counts cover all of them, weights a sample."""
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    total, df = document_frequencies(known, text, buckets)
    languages = sorted(r[0] for r in known.select(lang).distinct().collect())
    idf = np.log((1 + total) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            packed = [pack(*nonzero(ngrams(t, letters, buckets), buckets)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array(packed, pa.binary())], ["key", "lang", "features"]
            )

    chosen = sample(known.select(F.col(key).cast("string").alias("_key"), text, lang), "_key", most, "language")
    vectors = chosen.mapInArrow(run, "key string, lang string, features binary").collect()
    fitted, held = [], []
    model = Model(languages, idf, np.zeros((buckets, len(languages))), np.zeros(len(languages)), 1.0)
    for i, (_, language, data) in enumerate(in_order([(r.key or "", r.lang, bytes(r.features)) for r in vectors], 3)):
        at, counts = unpack(data)
        (held if i % CALIBRATION_PART == 0 else fitted).append((at, counts, languages.index(language)))
    if languages:
        model.weights, model.bias = fit_ftrl([(at, model.vector(at, c), y) for at, c, y in fitted], len(languages), buckets)
        logits = np.array([model.logits(at, c) for at, c, _ in held]).reshape(len(held), len(languages))
        model.temperature = fit_temperature(logits, np.array([y for *_, y in held], np.int64))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the calibrated probability of that language."""
    parts = (model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def make() -> Callable:
        model, letters = Model(*shared.value), letter_table()
        buckets = len(model.idf)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            names, scores = [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                features = ngrams(value, letters, buckets) if value and model.languages else ()
                if not len(features):
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                p = softmax(model.logits(*nonzero(features, buckets)) / model.temperature)
                best = int(p.argmax())
                names.append(model.languages[best]), scores.append(float(p[best]))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return columns

    return add_columns(docs, ADDED, make)


def held_out(key: Column) -> Column:
    """True for the quarter of documents that never teaches."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents that are not held out, then add ``lang_pred`` and ``score`` to all."""
    model = train(docs.where(~held_out(F.col(doc_id))).select(doc_id, text, lang), doc_id, text, lang)
    return predict(docs, model, text)
