"""Document likelihood over all segmentations into the pieces of a stored vocabulary.

A text is a sequence of words, a word is the word mark and its characters, and a piece
sequence ends with the end piece. The probability of a word is the sum over all its
segmentations, so the probability of a text is the product over its words and the end.
A word seen in training is one more edge of its lattice, over its whole length; these
edges share the probability that the next word is not new (Good-Turing), the pieces
share the rest. Piece weights start from the vocabulary's own scores and are re-estimated on the training
words by expectation-maximisation, with the first weights as a prior.

Every distinct word of the corpus is scored once: words travel to the task that owns their
hash range, counts and log probabilities travel back (see ``exchange``). Only the piece
weights, one number per piece, pass through the driver.

Cases: a null or empty text is just the end token; repeated rows count and are scored as
often as they occur; a null id is held out or not by the remainder of the empty string; an
empty table gives no rows, and without training documents the weights stay the first ones;
a long text is part of one batch, a long word is one row of the lattice; input columns
named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.llm import exchange as X
from lingweave.llm.lattice import Pieces, Weights, expected_counts, load_pieces, log_probabilities
from lingweave.llm.text import sums_by_text
from lingweave.session import stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 3  # of expectation-maximisation
PRIOR = 1e-3  # weight of the first weights, as a share of the training pieces
SMOOTH = 0.1  # fixed value: added to the counts of the base model
END = "</s>"

ADDED = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def first_weights(scores: list[float], kinds: list[str], texts: list[str]) -> np.ndarray:
    """Probabilities from the stored scores.

    The scores of a merge vocabulary are negative ranks, so pieces get the share of their
    rank; bytes and the end get the share of the last rank; other control pieces none.
    """
    scores = np.array(scores)
    ranks = np.where(np.array(kinds) == "piece", -np.minimum(scores, 0), 0)
    last = len(scores)
    share = 1 / (np.minimum(ranks, last) + 10)
    usable = np.array([k in ("piece", "byte") or t == END for k, t in zip(kinds, texts)])
    share = np.where(np.array(kinds) == "piece", share, 1 / (last + 10)) * usable
    return share / share.sum()


def _log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def _expectation(owned: DataFrame, pieces, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in the training words; one row per piece reaches the driver."""
    size = len(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(*pieces.value)
        w, total = Weights.of(table, log_p), np.zeros(size)
        for batch in batches:
            times = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            seen = np.flatnonzero(times)
            total += expected_counts(batch.column(0).flatten().take(pa.array(seen)), times[seen], table, w)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

    rows = owned.where("batch is null").select("words", "times").mapInArrow(run, "piece bigint, uses double")
    out = np.zeros(size)
    for r in rows.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        out[r.piece] = r.uses
    return out


def with_word_edges(log_pieces: np.ndarray, times: np.ndarray, total: int, new: float) -> np.ndarray:
    """Log probability of words when an edge spans each word seen ``times`` in training."""
    if not new:
        return log_pieces
    return np.logaddexp(np.log(new) + log_pieces, _log((1 - new) * times / max(total, 1)))


def _answers(pieces, log_p: np.ndarray, total: int, new: float) -> Callable:
    """Counts and log probabilities of the words of one hash range, for every batch that asked."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table["batch"])).combine_chunks()
        vocabulary = Pieces(*pieces.value)
        log_word = log_probabilities(known["words"].combine_chunks().flatten(), vocabulary, Weights.of(vocabulary, log_p))
        times = known["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        answers = pa.table({"times": times, "log_word": with_word_edges(log_word, times, total, new)})
        return X.answer_rows(table, answers)

    return run


def score(
    docs: DataFrame, learn: Column, text: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR, word_edges: bool = True
) -> DataFrame:
    """Add token counts, the base model's score and the lattice model's log10 probability to every row.

    Rows where ``learn`` holds teach both models; null counts as not. Without ``word_edges``
    the lattice holds the pieces of the vocabulary only.
    """
    sc = docs.sparkSession.sparkContext
    added = [f.split(" ")[0] for f in ADDED.split(", ")]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in added]).withColumn("_learn", F.coalesce(learn, F.lit(False)))
    texts, scores, kinds = load_pieces(vocabulary)
    pieces = sc.broadcast((texts, kinds))
    ends = docs.where("_learn").count()

    sent = X.words_by_owner(docs, text, True, X.owners(docs), "_learn")
    owned = stored(X.owned(sent), "lm-words")
    times = F.col("times")
    summed = owned.where("batch is null").agg(
        F.sum(F.aggregate(times, F.lit(0).cast("long"), lambda a, t: a + t)).alias("tokens"),
        F.sum(F.size(F.filter(times, lambda t: t > 0))).alias("distinct"),
        F.sum(F.size(F.filter(times, lambda t: t == 1))).alias("once"),
    )
    totals = summed.first()
    n = (totals["tokens"] or 0) + ends
    v = (totals["distinct"] or 0) + (ends > 0)

    # chance that the next word is new; 0 switches the edges of whole words off
    new = min(0.5, max(1e-4, (totals["once"] or 0) / n)) if word_edges and n else 0.0

    first = first_weights(scores, kinds, texts)
    p = first
    for _ in range(rounds if n else 0):
        uses = _expectation(owned, pieces, _log(p))
        uses[texts.index(END)] += ends
        weight = max(1.0, prior * uses.sum())
        p = (uses + weight * first) / (uses.sum() + weight)
    log_p = _log(p)

    answers = owned.groupBy("owner").applyInArrow(_answers(pieces, log_p, n, new), X.ANSWER)
    below = np.log10(SMOOTH * (v + 1) + n)
    log_end = float(with_word_edges(log_p[[texts.index(END)]], np.array([ends]), n, new)[0])

    def make() -> Callable:
        def columns(chunk, place: np.ndarray, answers: pa.Table | None, rows: pa.Table) -> list[pa.Array]:
            times, log_word = (answers[c].to_numpy().astype(np.float64) if answers else np.zeros(0) for c in ("times", "log_word"))
            bounds = chunk.bounds()
            base = sums_by_text((np.log10(times + SMOOTH) - below)[place] if len(place) else np.zeros(0), bounds)
            marginal = sums_by_text(log_word[place] if len(place) else np.zeros(0), bounds)
            known = sums_by_text((times > 0)[place].astype(np.int64) if len(place) else np.zeros(0, np.int64), bounds)
            return [
                pa.array(np.diff(bounds) + 1),
                pa.array(known + (ends > 0)),
                pa.array(np.full(chunk.rows, n, np.int64)),
                pa.array(base + (np.log10(ends + SMOOTH) - below)),
                pa.array((marginal + log_end) / np.log(10)),
            ]

        return columns

    return X.answered(docs, text, True, answers, ADDED, make, drop=("_learn",))


def held_out(key: Column) -> Column:
    """True for the tenth of documents that never teaches."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 10 == 0
