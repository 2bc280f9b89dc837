"""Social-media text cleaning rules, each one ``Column -> Column``.

Every rule is a native expression, so a cleaned projection stays inside one
JVM stage whatever the number of columns or rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lingweave.functions.whitespace import WS, collapse, strip

# Code-point ranges treated as emoji. The last range is far wider
# than flags and also takes CJK, kana, Hangul and full-width forms; results must
# equal that behaviour, so it is the default.
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F300, 0x1F5FF),  # symbols and pictographs
    (0x1F680, 0x1F6FF),  # transport and map
    (0x1F700, 0x1F77F),  # alchemical
    (0x1F780, 0x1F7FF),  # geometric shapes extended
    (0x1F800, 0x1F8FF),  # supplemental arrows C
    (0x1F900, 0x1F9FF),  # supplemental symbols and pictographs
    (0x1FA00, 0x1FA6F),  # chess symbols
    (0x1FA70, 0x1FAFF),  # symbols and pictographs extended A
    (0x2702, 0x27B0),  # dingbats
    (0x24C2, 0x1F251),  # enclosed characters up to flags
]
# Narrow option: the wide range replaced by enclosed alphanumerics, the
# miscellaneous symbols, variation selectors and the enclosed supplement.
NARROW_RANGES = EMOJI_RANGES[:-1] + [
    (0x24C2, 0x24C2),
    (0x2600, 0x26FF),
    (0xFE00, 0xFE0F),
    (0x1F100, 0x1F251),
]


def emoji_class(narrow: bool = False) -> str:
    ranges = NARROW_RANGES if narrow else EMOJI_RANGES
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def remove_urls(c: Column) -> Column:
    """Delete ``http`` and all that follows up to whitespace (case-sensitive)."""
    return F.regexp_replace(c, f"http[^{WS}]+", "")


def remove_usernames(c: Column) -> Column:
    """Delete the placeholder ``<user>`` and strip."""
    return strip(F.replace(c, F.lit("<user>"), F.lit("")))


def remove_rt(c: Column) -> Column:
    """Delete the retweet marker ``RT :`` and strip."""
    return strip(F.replace(c, F.lit("RT :"), F.lit("")))


def remove_hashtags_and_mentions(c: Column, retain_text: bool = False) -> Column:
    """Delete hashtags, then mentions. ``retain_text`` only deletes ``#`` signs.

    One scan does both: a mention never starts right before a hashtag, since
    the hashtag would have gone first and left a bare ``@``.
    """
    if retain_text:
        return F.replace(c, F.lit("#"), F.lit(""))
    return F.regexp_replace(c, f"#[^{WS}]+|@(?!#[^{WS}])[^{WS}]+", "")


def handle_emojis(c: Column, remove: bool = False, narrow: bool = False) -> Column:
    """Delete emoji runs when ``remove``; otherwise the text as it is."""
    # the range test in front lets ASCII and Latin text skip the list of ranges
    return F.regexp_replace(c, f"[\\x{{24C2}}-\\x{{1FAFF}}&&[{emoji_class(narrow)}]]+", "") if remove else c


def standardize_punctuation(c: Column) -> Column:
    """Collapse runs of the same ``!``, ``.`` or ``?``."""
    return F.regexp_replace(c, r"([!.?])\1+", "$1")


def to_lowercase(c: Column) -> Column:
    return F.lower(c)


def trim_extra_spaces(c: Column) -> Column:
    """Strip and collapse whitespace runs to one space."""
    return collapse(strip(c))


def remove_non_alpha(c: Column) -> Column:
    """Delete everything but ASCII letters and whitespace."""
    # keeping the wanted runs is several times faster in Java than deleting a negated class
    return F.array_join(F.regexp_extract_all(c, F.lit(f"[a-zA-Z {WS}]+"), 0), "")


Rule = Callable[[Column], Column]


def clean_rules(
    retain_hashtag_text: bool = False,
    remove_emoji: bool = True,
    letters_only: bool = False,
    narrow_emoji: bool = False,
) -> list[tuple[str, Rule]]:
    """The cleaning chain as ``(name, rule)`` in the order the rules apply."""
    rules: list[tuple[str, Rule]] = [
        ("urls", remove_urls),
        ("usernames", remove_usernames),
        ("rt", remove_rt),
        ("tags", lambda c: remove_hashtags_and_mentions(c, retain_hashtag_text)),
        ("emojis", lambda c: handle_emojis(c, remove_emoji, narrow_emoji)),
    ]
    if letters_only:
        rules.append(("non_alpha", remove_non_alpha))
    return rules + [
        ("punctuation", standardize_punctuation),
        ("lowercase", to_lowercase),
        ("spaces", trim_extra_spaces),
    ]


def clean_text(c: Column, **options: bool) -> Column:
    """The whole chain; ``options`` as in :func:`clean_rules`."""
    for _, rule in clean_rules(**options):
        c = rule(c)
    return c


def clean_text_alpha(
    c: Column, retain_hashtag_text: bool = False, remove_emoji: bool = False
) -> Column:
    """Letters-only variant of the chain (emoji rule off unless asked for)."""
    return clean_text(
        c,
        retain_hashtag_text=retain_hashtag_text,
        remove_emoji=remove_emoji,
        letters_only=True,
    )
