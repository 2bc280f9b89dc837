"""Quality rules: counts of a text, fixed limits, and a calibrated classifier of low quality.

The classifier is a logistic regression on hashed words and byte trigrams, fitted on a
bounded sample of labelled rows and calibrated on the part of the sample that fitting did
not see. The model has a fixed size; tasks score whole texts in Arrow batches, and no
document is shuffled. Labels reach the documents by a join on the sampled ids only.

Cases: a null or empty text has no words, so it fails the base rules; null labels teach
nothing; without labels of both kinds the verdict is that of the base rules; an id labelled
twice teaches with its lower label; repeated rows are judged alike; empty tables give no
rows; input columns named like an output are replaced; very long texts only cost time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingweave.llm.features import in_order, nonzero, pack, sample, unit, unpack
from lingweave.llm.text import WHITE, Chunk, Hasher, add_columns, chunks, sums_by_text, word_table

# Symbols that are counted, least words, window of a repeat, most repeated words in a hundred.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20

BUCKETS = 1 << 16
SAMPLE_ROWS = 3000  # labelled rows that the classifier is fitted on, about
CALIBRATION_PART = 4  # one sampled row in this many calibrates
REJECT = 0.5  # texts of at least this probability of low quality go

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
ADDED = f"{BASE}, base_failed boolean, low_quality double, kept boolean"


def _distinct(keys: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of every text."""
    salted = keys ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(salted, return_index=True)
    return np.bincount(text[first], minlength=rows)


def duplicate_lines(chunk: Chunk, inside: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.unique(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(chunk.data)]
    text = np.searchsorted(chunk.offsets, starts, "right") - 1
    # a line ends at the next break or with its text
    following = np.append(breaks, len(chunk.data))[np.searchsorted(breaks, starts, "left")]
    ends = np.minimum(following, chunk.offsets[text + 1])
    worded = np.concatenate([[0], np.cumsum(inside)])
    full = worded[ends] > worded[starts]
    starts, ends, text = starts[full], ends[full], text[full]
    return np.bincount(text, minlength=chunk.rows) - _distinct(hasher.spans(chunk.data, starts, ends), text, chunk.rows)


def repeated_words(chunk: Chunk, words: np.ndarray, size: int, hasher: Hasher) -> np.ndarray:
    """Words inside windows that their text holds twice or more."""
    windows = hasher.windows(words, size)
    inside = np.flatnonzero(chunk.text[: len(windows)] == chunk.text[size - 1 :][: len(windows)])
    key = windows[inside] ^ (chunk.text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    again = inside[order[np.append(same, False) | np.concatenate([[False], same])]] if len(order) else order
    marks = np.zeros(len(words) + 1, np.int64)
    marks[again] += 1
    np.add.at(marks, again + size, -1)
    return sums_by_text((np.cumsum(marks[:-1]) > 0).astype(np.int64), chunk.bounds())


def base_counts(chunk: Chunk, table: np.ndarray, words: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """The five counts of every text."""
    inside = table[chunk.data]
    letters = inside & (chunk.data & 0xC0 != 0x80)  # first bytes of characters
    symbols = np.isin(chunk.data, np.frombuffer(SYMBOLS, np.uint8))
    return [
        np.diff(chunk.bounds()),
        sums_by_text(letters, chunk.offsets),
        sums_by_text(symbols, chunk.offsets),
        duplicate_lines(chunk, inside, hasher),
        repeated_words(chunk, words, WINDOW, hasher),
    ]


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def text_features(chunk: Chunk, words: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the words and byte trigrams of every text."""
    bits = int(np.log2(buckets))
    word = (words >> np.uint64(64 - bits)).astype(np.int64)
    d = chunk.data.astype(np.uint32)
    three = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16) if len(d) > 2 else d[:0]
    three = (three * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64)
    bounds = chunk.bounds()
    for r in range(chunk.rows):
        last = max(chunk.offsets[r], chunk.offsets[r + 1] - 2)
        yield np.concatenate([word[bounds[r] : bounds[r + 1]], three[chunk.offsets[r] : last]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # calibration of the logit
    shift: float

    def logit(self, at: np.ndarray, counts: np.ndarray) -> float:
        return float(unit(np.log1p(counts)) @ self.weights[at] + self.bias)

    def probability(self, at: np.ndarray, counts: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(at, counts) + self.shift, -35, 35))))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, l2: float = 1e-4, steps: int = 150, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on unit vectors by full-batch AdaGrad; both classes weigh the same."""
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows]).astype(np.float32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows], np.float64)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(buckets), 0.0
    seen, seen_b = np.full(buckets, 1e-12), 1e-12
    for _ in range(steps):
        z = np.bincount(row, x * w[at], len(rows)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        g = np.bincount(at, x * error[row], buckets) + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(seen_b)
    return w, float(b)


def fit_calibration(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton's method with softened targets."""
    positive, negative = y.sum(), len(y) - y.sum()
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    both = np.stack([logits, np.ones(len(y))], 1)
    p = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(both @ p, -35, 35)))
        slope = both.T @ (q - target) + 1e-3 * (p - [1.0, 0.0])
        curve = (both * (q * (1 - q))[:, None]).T @ both + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        p -= step / max(1.0, np.abs(step).max())
    return float(max(p[0], 1e-3)), float(p[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model | None:
    """Fit on about ``most`` labelled rows; ``None`` without rows of both kinds."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(doc_id).agg(F.min(label).cast("int").alias("_label"))
    chosen = sample(known, doc_id, most, "quality").select(F.col(doc_id).alias("_id"), "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), word_table(WHITE)
        for batch in batches:
            packed = []
            for chunk in chunks(batch.column(1), table):
                words = hasher.spans(chunk.data, chunk.starts, chunk.ends)
                packed += [pack(*nonzero(f, buckets)) for f in text_features(chunk, words, buckets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array(packed, pa.binary())], ["key", "label", "features"]
            )

    # about ``most`` ids, a bounded side
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), docs[doc_id] == F.col("_id")).select(doc_id, text, "_label")
    vectors = rows.where(F.col(text).isNotNull()).mapInArrow(run, "key string, label int, features binary").collect()
    fitted, held = [], []
    for i, (_, low, data) in enumerate(in_order([(r.key, int(r.label == 0), bytes(r.features)) for r in vectors], 5)):
        (held if i % CALIBRATION_PART == 0 else fitted).append((*unpack(data), low))
    if len({low for *_, low in fitted}) < 2:
        return None
    w, b = fit_logistic([(at, unit(np.log1p(c)), low) for at, c, low in fitted], buckets)
    del fitted, vectors
    model = Model(w, b, 1.0, 0.0)
    model.slope, model.shift = fit_calibration(np.array([model.logit(at, c) for at, c, _ in held]), np.array([low for *_, low in held]))
    return model


def judge(docs: DataFrame, model: Model | None, text: str = "text", reject: float = REJECT) -> DataFrame:
    """Add the base counts, ``base_failed``, ``low_quality`` (a probability, null without model) and ``kept``."""
    parts = model and (model.weights.astype(np.float32), model.bias, model.slope, model.shift)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def make() -> Callable:
        model = shared.value and Model(*shared.value)
        hasher, table = Hasher(), word_table(WHITE)

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, scores = [[np.zeros(0, np.int64)] for _ in range(5)], []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text)), table):
                words = hasher.spans(chunk.data, chunk.starts, chunk.ends)
                for into, values in zip(counts, base_counts(chunk, table, words, hasher)):
                    into.append(values)
                if model:
                    size = len(model.weights)
                    scores += [model.probability(*nonzero(f, size)) for f in text_features(chunk, words, size)]
                else:
                    scores += [None] * chunk.rows
            counts = [np.concatenate(c) for c in counts]
            failed = base_failed(counts[0], counts[4])
            low = np.array([s is not None and s >= reject for s in scores], bool)
            return [
                *[pa.array(c.astype(np.int64)) for c in counts],
                pa.array(failed),
                pa.array(scores, pa.float64()),
                pa.array(~failed & ~low),
            ]

        return columns

    return add_columns(docs, ADDED, make)


def rate(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Train on the labelled rows, then judge all documents."""
    return judge(docs, train(docs, labels, doc_id, text, label), text)
