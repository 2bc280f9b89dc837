"""Corpus BLEU, chrF and embedding match as sums of per-row statistics.

Every metric here is a closed form of additive counts (or a mean of row scores).
The counts are taken once per row where the row lies, so a report for any grouping
is one partial aggregation of a few integers: no n-gram is shuffled and a source
with a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lingweave.functions.ngrams import ngram_stats, stat_names, word_and_character_stats
from lingweave.functions.tokens import tokenize_13a
from lingweave.functions.whitespace import drop_whitespace
from lingweave.operators.embedding import with_embedding_prf
from lingweave.operators.infer import require_columns
from lingweave.session import small_batches

WORD_ORDER = 4
CHAR_ORDER = 6
BLEU = stat_names("bleu", WORD_ORDER)
PLAIN = stat_names("plain", WORD_ORDER)
CHRF = stat_names("chrf", CHAR_ORDER)
PRF = ["precision", "recall", "f1"]


def _expand(df: DataFrame, stats: Column) -> DataFrame:
    small_batches(df.sparkSession)
    return df.withColumn("_stats", stats).select(*df.columns, "_stats.*")


def with_bleu_stats(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Add the 13a word n-gram counts of each row."""
    return _expand(
        df, ngram_stats(tokenize_13a(F.col(hyp)), tokenize_13a(F.col(ref)), WORD_ORDER, True, "bleu")
    )


def with_plain_stats(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Add word n-gram counts on bare whitespace tokens."""
    return _expand(df, ngram_stats(F.col(hyp), F.col(ref), WORD_ORDER, True, "plain"))


def with_chrf_stats(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Add character n-gram counts; hypothesis grams count only where the reference has grams."""
    bare = [drop_whitespace(F.col(c)) for c in (hyp, ref)]
    return counted(_expand(df, ngram_stats(*bare, CHAR_ORDER, False, "chrf")))


def pair_stats(hyps: Sequence[str], ref: str) -> Column:
    """Struct ``h0, h1, ...`` of the BLEU and chrF counts of each hypothesis, from one Arrow step; see :func:`counted`."""
    first, *others = (F.col(c).cast("string") for c in (ref, *hyps))
    return word_and_character_stats(first, others, (WORD_ORDER, CHAR_ORDER), ("bleu", "chrf"))


def counted(df: DataFrame) -> DataFrame:
    """Hypothesis character grams count only where the reference has grams."""
    columns = {f"chrf_hyp{n}": F.when(F.col(f"chrf_ref{n}") > 0, F.col(f"chrf_hyp{n}")).otherwise(F.lit(0)) for n in range(1, CHAR_ORDER + 1)}
    return df.withColumns(columns)


def sums(names: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _counts(prefix: str, n: int) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}_{kind}{n}").cast("double") for kind in ("match", "hyp", "ref"))


def brevity(hyp_len: Column, ref_len: Column) -> Column:
    return (
        F.when(hyp_len >= ref_len, F.lit(1.0))
        .when(hyp_len > 0, F.exp(1.0 - ref_len / hyp_len))
        .otherwise(F.lit(0.0))
    )


def bleu_score() -> Column:
    """Corpus BLEU 0..100 of summed counts, exponential smoothing of empty orders."""
    orders = range(1, WORD_ORDER + 1)
    matched = [_counts("bleu", n)[0] for n in orders]
    total = [_counts("bleu", n)[1] for n in orders]
    logs, halvings = F.lit(0.0), F.lit(0)
    for m, t in zip(matched, total):
        halvings = halvings + F.when(m == 0, 1).otherwise(0)
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), halvings) * t)
        logs = logs + F.log(F.when(m == 0, smoothed).otherwise(m * 100.0 / t))
    defined = reduce(lambda a, b: a & b, [t > 0 for t in total]) & (reduce(lambda a, b: a + b, matched) > 0)
    score = brevity(total[0], _counts("bleu", 1)[2]) * F.exp(logs / WORD_ORDER)
    return F.when(defined, score).otherwise(F.lit(0.0))


def plain_bleu_score() -> Column:
    """BLEU 0..1 of summed counts without smoothing; 0 when any order has no match."""
    orders = range(1, WORD_ORDER + 1)
    logs, defined = F.lit(0.0), F.lit(True)
    for n in orders:
        m, t, _ = _counts("plain", n)
        defined = defined & (m > 0)
        logs = logs + F.log(m / t)
    _, hyp_len, ref_len = _counts("plain", 1)
    return F.when(defined, brevity(hyp_len, ref_len) * F.exp(logs / WORD_ORDER)).otherwise(F.lit(0.0))


def chrf_score(beta: float = 2.0) -> Column:
    """chrF 0..100 of summed counts, averaged over the orders both sides have."""
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHAR_ORDER + 1):
        m, h, r = _counts("chrf", n)
        both = (h > 0) & (r > 0)
        precision = precision + F.when(both, m / h).otherwise(0.0)
        recall = recall + F.when(both, m / r).otherwise(0.0)
        used = used + F.when(both, 1).otherwise(0)
    p, r = precision / used, recall / used
    factor = beta * beta
    defined = (used > 0) & (precision + recall > 0)
    return F.when(defined, (1 + factor) * p * r / (factor * p + r) * 100.0).otherwise(F.lit(0.0))


def bleu(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    """``by..., score`` of every group (one row overall without ``by``)."""
    return with_bleu_stats(df, hyp, ref).groupBy(*by).agg(*sums(BLEU)).select(*by, bleu_score().alias("score"))


def plain_bleu(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    return with_plain_stats(df, hyp, ref).groupBy(*by).agg(*sums(PLAIN)).select(*by, plain_bleu_score().alias("score"))


def chrf(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    return with_chrf_stats(df, hyp, ref).groupBy(*by).agg(*sums(CHRF)).select(*by, chrf_score().alias("score"))


def batch_mean_bleu(stats: DataFrame, batch: Sequence[str], *by: str) -> DataFrame:
    """Unweighted mean of the scores of single batches, which differs from the corpus score."""
    per_batch = stats.groupBy(*by, *batch).agg(*sums(BLEU)).select(*by, *batch, bleu_score().alias("score"))
    return per_batch.groupBy(*by).agg(F.avg("score").alias("score"))


def compare_systems(df: DataFrame, systems: Sequence[str], ref: str, by: str = "source") -> DataFrame:
    """``system, by, bleu, chrf`` of several hypothesis columns against one reference column.

    A reference is prepared once for all systems; only counts are spread into rows.
    """
    require_columns(df, *systems, ref, by)
    small_batches(df.sparkSession)
    stats = df.select(by, pair_stats(systems, ref).alias("_all"))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"_all.h{k}").alias("_stats")) for k, s in enumerate(systems)]))
    long = counted(stats.select(by, rows.alias("_row")).select("_row.system", by, "_row._stats.*"))
    scored = long.groupBy("system", by).agg(*sums(BLEU), *sums(CHRF))
    return scored.select("system", by, bleu_score().alias("bleu"), chrf_score().alias("chrf"))


def report(
    df: DataFrame,
    forced: str,
    generated: str,
    ref: str,
    generated_ids: str,
    ref_ids: str,
    vectors: DataFrame,
    by: str = "source",
) -> DataFrame:
    """BLEU, chrF and embedding match per group and overall (``by`` null) in one pass.

    BLEU and chrF score the forced hypothesis, the embedding match the generated
    one; pass the same column twice to score one hypothesis.
    """
    require_columns(df, forced, generated, ref, generated_ids, ref_ids, by)
    small_batches(df.sparkSession)
    df = with_embedding_prf(df, generated_ids, ref_ids, vectors)
    stats = counted(df.select(by, *PRF, pair_stats([forced], ref).alias("_all")).select(by, *PRF, "_all.h0.*"))
    scored = stats.rollup(by).agg(*sums(BLEU), *sums(CHRF), *[F.avg(c).alias(c) for c in PRF])
    return scored.select(by, bleu_score().alias("bleu"), chrf_score().alias("chrf"), *PRF)
