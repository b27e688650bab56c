"""Registered queries against their DuckDB SQL, on the smallest tables."""

import collections
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = collections.Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        q = db.execute(sql)
        names = [d[0] for d in q.description]
        assert sorted(names) == cols
        want = collections.Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in q.fetchall())
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
