"""Denoising examples from id arrays: unit masks, span masks, span permutations.

Every random choice is a value of the seed and of row, position or batch keys, so
the examples are the same on any cluster, after any retry and in any engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lingweave.functions import arrays as A
from lingweave.functions.rng import below, drawn, uniform


@dataclass(frozen=True)
class Noise:
    """Settings of the denoising tasks (fixed values as defaults)."""

    special_ids: Sequence[int]
    mask_id: int
    seed: int = 42
    mask_probability: float = 0.15
    group_mask: bool = True
    mask_max_length: int = 5
    permute_probability: float = 0.5
    permute_max_length: int = 5
    permute_min_window: int = 2
    style_switch_probability: float = 0.15


def _zeros(ids: Column) -> Column:
    return A.repeat(0, F.size(ids))


def _unit_head(row: Column, noise: Noise) -> Column:
    """What the drawn keys of a row's positions begin with."""
    return F.concat_ws("|", F.lit(str(noise.seed)), F.lit("unit"), row.cast("string"), F.lit(""))


def unit_mask(ids: Column, row: Column, noise: Noise, head: Column | None = None) -> Column:
    """1 where a non-special position is drawn, each on its own.

    A ``head`` column of :func:`_unit_head` saves putting the keys together for each position.
    """
    fixed = [*noise.special_ids, A.IGNORE]
    head = _unit_head(row, noise) if head is None else head

    def draw(x: Column, i: Column) -> Column:
        hit = ~x.isin(*fixed) & below(F.md5(F.concat(head, i.cast("string"))), noise.mask_probability)
        return hit.cast("int")

    return F.transform(ids, draw)


def with_window(
    df: DataFrame,
    ids: str,
    row: str,
    noise: Noise,
    probability: float,
    max_length: int,
    min_length: int,
    tag: str,
    where: Column | None = None,
) -> DataFrame:
    """Add ``_start`` and ``_size`` of a row's window; size 0 means no window.

    A row takes part with ``probability``, if it is one of those ``where`` names. The
    window length is drawn from 0 to ``max_length`` (no longer than the free span) and
    raised to ``min_length``. It ends before the last free token, so that token is never
    covered. Ids of rows that take no part are not looked at.
    """
    key = F.col(row)

    def u(what: str) -> Column:
        return uniform(noise.seed, f"{tag}-{what}", key)

    part = drawn(noise.seed, f"{tag}-row", probability, key)
    df = df.withColumn("_part", part if where is None else where & part)
    df = df.withColumn("_special", F.when(F.col("_part"), A.special_mask(F.col(ids), noise.special_ids)))
    first = (F.array_position("_special", 0) - 1).cast("int")
    last = (F.size("_special") - F.array_position(F.reverse("_special"), 0)).cast("int")
    free = F.size(F.array_remove("_special", 1))
    span = F.col("_last") - F.col("_first") + 1
    length = F.floor(u("size") * (F.least(F.lit(max_length), span) + 1)).cast("int")
    takes_part = F.col("_part") & (F.col("_free") > 1)
    room = F.col("_last") - F.col("_size") - F.col("_first") + 1
    fits = (F.col("_size") > 0) & (room > 0)
    return (
        df.withColumn("_first", first)
        .withColumn("_last", last)
        .withColumn("_free", free)
        .withColumn("_size", F.when(takes_part, F.greatest(F.lit(min_length), length)).otherwise(0))
        .withColumn("_start", F.when(fits, F.col("_first") + F.floor(u("start") * room).cast("int")).otherwise(0))
        .withColumn("_size", F.when(fits, F.col("_size")).otherwise(0))
        .drop("_part", "_special", "_first", "_last", "_free")
    )


def window_mask(ids: Column) -> Column:
    """1 inside the window of :func:`with_window`, else 0."""
    after = F.size(ids) - F.col("_start") - F.col("_size")
    return F.concat(A.repeat(0, F.col("_start")), A.repeat(1, F.col("_size")), A.repeat(0, after))


def group_mask(df: DataFrame, ids: str, row: str, noise: Noise, out: str = "mask") -> DataFrame:
    """Add a span mask to a share of the rows."""
    df = with_window(df, ids, row, noise, noise.mask_probability, noise.mask_max_length, 0, "group")
    return df.withColumn(out, window_mask(F.col(ids))).drop("_start", "_size")


def _labels(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(A.IGNORE)))


def _masked(ids: Column, mask: Column, mask_id: int) -> Column:
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, F.lit(mask_id)).otherwise(x))


def _spans(noise: Noise, batch: str) -> Column:
    """Whether a whole batch uses span masks."""
    return drawn(noise.seed, "style", noise.style_switch_probability, F.col(batch))


def mask_tokens(df: DataFrame, ids: str, row: str, batch: str, noise: Noise, enabled: bool = True) -> DataFrame:
    """Masking task: add ``denoised, mask, mask_labels``; ``ids`` stays as it is.

    A whole batch uses span masks with the style-switch probability, otherwise
    unit masks. Switched off, ids pass through and all labels are ignored.
    """
    if not enabled:
        return pass_through(df, ids)
    column = F.col(ids)
    df = df.withColumn("_head", _unit_head(F.col(row), noise))
    unit = unit_mask(column, F.col(row), noise, F.col("_head"))
    if noise.group_mask:
        df = df.withColumn("_spans", _spans(noise, batch))
        df = with_window(
            df, ids, row, noise, noise.mask_probability, noise.mask_max_length, 0, "group", F.col("_spans")
        )
        unit = F.when(F.col("_spans"), window_mask(column)).otherwise(unit)
    df = df.withColumn("mask", unit).drop("_head", "_spans", "_start", "_size")
    return df.withColumn("denoised", _masked(column, F.col("mask"), noise.mask_id)).withColumn(
        "mask_labels", _labels(column, F.col("mask"))
    )


def _permute_window(df: DataFrame, ids: str, row: str, noise: Noise, where: Column | None = None) -> DataFrame:
    return with_window(
        df, ids, row, noise, noise.permute_probability, noise.permute_max_length, noise.permute_min_window, "permute", where
    )


def _permuted(ids: Column, row: Column, noise: Noise) -> Column:
    """Ids with the window of :func:`with_window` shuffled."""
    start, size = F.col("_start"), F.col("_size")

    def keyed(x: Column, i: Column) -> Column:
        place = uniform(noise.seed, "permute-place", row, start + i)
        return F.struct(place.alias("place"), i.alias("i"), x.alias("id"))

    window = F.slice(ids, start + 1, size)
    shuffled = F.transform(F.sort_array(F.transform(window, keyed)), lambda s: s["id"])
    rest = F.slice(ids, start + size + 1, F.size(ids))
    return F.when(size > 0, F.concat(F.slice(ids, F.lit(1), start), shuffled, rest)).otherwise(ids)


def permute_tokens(df: DataFrame, ids: str, row: str, noise: Noise, enabled: bool = True) -> DataFrame:
    """Permutation task: shuffle one window; adds ``denoised, mask, mask_labels``."""
    if not enabled:
        return pass_through(df, ids)
    column = F.col(ids)
    return (
        _permute_window(df, ids, row, noise)
        .withColumn("mask", window_mask(column))
        .withColumn("denoised", _permuted(column, F.col(row), noise))
        .withColumn("mask_labels", _labels(column, F.col("mask")))
        .drop("_start", "_size")
    )


def pass_through(df: DataFrame, ids: str) -> DataFrame:
    """No noise: ids unchanged, mask 0, every label ignored."""
    column = F.col(ids)
    return (
        df.withColumn("denoised", column)
        .withColumn("mask", _zeros(column))
        .withColumn("mask_labels", A.repeat(A.IGNORE, F.size(column)))
    )


def denoise_mixed(df: DataFrame, ids: str, row: str, batch: str, noise: Noise) -> DataFrame:
    """Each batch takes the masking or the permutation task, one chance in two.

    The same values as of :func:`mask_tokens` and :func:`permute_tokens`, but a row
    computes its own task only.
    """
    column, masks, spans = F.col(ids), F.col("_masks"), F.col("_spans")
    both = df.withColumns(
        {
            "_masks": drawn(noise.seed, "task", 0.5, F.col(batch)),
            "_spans": _spans(noise, batch) if noise.group_mask else F.lit(False),
            "_head": _unit_head(F.col(row), noise),
        }
    )
    both = with_window(
        both, ids, row, noise, noise.mask_probability, noise.mask_max_length, 0, "group", masks & spans
    ).withColumnsRenamed({"_start": "_span_start", "_size": "_span_size"})
    both = _permute_window(both, ids, row, noise, ~masks)
    both = both.withColumns({c: F.when(masks, F.col(f"_span{c}")).otherwise(F.col(c)) for c in ("_start", "_size")})
    unit = unit_mask(column, F.col(row), noise, F.col("_head"))
    both = both.withColumn("mask", F.when(masks & ~spans, unit).otherwise(window_mask(column)))
    masked = _masked(column, F.col("mask"), noise.mask_id)
    return both.select(
        *df.columns,
        F.when(masks, F.lit("mask")).otherwise(F.lit("permute")).alias("task"),
        F.when(masks, masked).otherwise(_permuted(column, F.col(row), noise)).alias("denoised"),
        "mask",
        _labels(column, F.col("mask")).alias("mask_labels"),
    )
