"""Every query with SQL gives DuckDB's rows; the others run and give rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from corpusjobs.plans import all_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float | Decimal):
        return f"{float(v):.6f}"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, duck, name):
    got = all_queries.QUERIES[name](spark, DIR)
    if name not in all_queries.ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(all_queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
