"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from tidemark.catalogue import entries
from tidemark.catalogue.views import BASE

QUERIES, ORACLE = {n: q for n, q in queries().items() if n in entries()}, oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in ORACLE:
        assert found
        return
    result = duck.execute(ORACLE[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    assert found == expected


def test_entry(spark):
    assert entry(spark).count() > 0


def test_only_iterative_or_dialect_bound_queries_lack_sql():
    own = set(entries())
    assert own - set(ORACLE) == {"holt_winters_forecast", "additive_forecast"}
