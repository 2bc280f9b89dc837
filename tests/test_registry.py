"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lingweave.plans.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf) / table}.parquet'")
    return con


def _rows(columns, data):
    fix = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(fix(v) for v in row) for row in zip(*[data[c] for c in columns])), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toArrow().to_pydict()
    expected = duck.execute(entry.oracle_sql()[name]).to_arrow_table().to_pydict()
    assert sorted(got) == sorted(expected)
    columns = sorted(got)
    assert _rows(columns, got) == _rows(columns, expected)


def test_entry(spark):
    assert entry.entry(spark).columns == ["split", "source", "rows", "tokens"]
