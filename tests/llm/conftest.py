from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 977} and{i % 13}" for i in range(20_000))
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today, again and again.", "en"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today, again and again.", "en"),
    (2, "Der schnelle braune Fuchs springt über den faulen Hund am Flußufer heute, immer wieder und wieder.", "de"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n \r\n ", "en"),
    (6, "12345 %% 67", None),
    (None, "one two three four five six seven eight nine ten eleven twelve", None),
    (7, LONG, "en"),
    (7, "x", "en"),
    (8, "👅 ñandú ▁mark  two  blanks\n\nlines\n", "es"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, other columns with names the operators add."""
    rows = [(*r, 9, "kept", "extra") for r in EDGE_ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_words int, `score` string, `a.b` string"
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
