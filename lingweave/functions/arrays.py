"""Expressions on token-id arrays: framing, padding, masks, arg-max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Special tokens in id order, the mask token, lengths and labels.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>"]
BOS, PAD, EOS, UNK = range(4)
MASK_TOKEN = "<mask>"
MAX_LENGTH = 30
IGNORE = -100


def ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), times.cast("int"))


def truncate(tokens: Column, max_length: int = MAX_LENGTH) -> Column:
    """Keep the tokens that fit between the two border tokens."""
    return F.slice(tokens, 1, max_length - 2)


def frame(ids: Column) -> Column:
    return F.concat(ints([BOS]), ids, ints([EOS]))


def pad(ids: Column, length: Column | int = MAX_LENGTH, value: int = PAD) -> Column:
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, repeat(value, missing))


def attention_mask(ids: Column, length: Column | int = MAX_LENGTH) -> Column:
    """1 for the tokens of an unpadded array, 0 up to ``length``."""
    return pad(repeat(1, F.size(ids)), length, 0)


def ignore_pads(ids: Column) -> Column:
    """Labels: every pad id becomes the ignored label."""
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORE)).otherwise(x))


def restore_ignored(ids: Column) -> Column:
    """Ignored labels become the end token before decoding."""
    return F.transform(ids, lambda x: F.when(x == IGNORE, F.lit(EOS)).otherwise(x))


def special_mask(ids: Column, special_ids: Sequence[int]) -> Column:
    """1 at special ids (borders, pad, unknown, mask), else 0."""
    return F.transform(
        ids, lambda x: F.when(x.isin(*special_ids), F.lit(1)).otherwise(F.lit(0)).cast("int")
    )


def pad_positions(ids: Column) -> Column:
    """0-based positions of pad ids."""
    where = F.transform(ids, lambda x, i: F.when(x == PAD, i).otherwise(F.lit(-1)))
    return F.filter(where, lambda i: i >= 0)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_decode(logits: Column) -> Column:
    """Arg-max of every step of an array of logit arrays."""
    return F.transform(logits, argmax)


def steps(flat: Column, width: int) -> Column:
    """Cut a flat logit array into steps of ``width`` values."""
    count = F.floor(F.size(flat) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda s: F.slice(flat, s * width + 1, width))


def joined(c: Column, separator: str = " ") -> Column:
    """Array as text, for logs and engine-neutral comparison."""
    return F.array_join(c.cast("array<string>"), separator)
