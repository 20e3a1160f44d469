"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from lattica import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return None if isinstance(v, float) and math.isnan(v) else v


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, small, name):
    own = catalog.QUERIES[name](spark, small)
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(own.columns) == sorted(sql.columns)
    assert table(own.columns, own.collect()) == table(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_sketches_are_close(spark, small):
    exact = catalog.rel(spark, small, "lineitem").select("l_orderkey").distinct().count()
    for name, off in (("hyper_log_log", 0.05), ("linear_counting", 0.02)):
        assert catalog.QUERIES[name](spark, small).first()[0] == pytest.approx(exact, rel=off)


def test_bernoulli_keeps_its_share(spark, small):
    n = catalog.rel(spark, small, "lineitem").count()
    assert catalog.QUERIES["bernoulli"](spark, small).count() == pytest.approx(0.1 * n, rel=0.25)


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
