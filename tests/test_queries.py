"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from vireo.plans import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(oracle.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_runs(spark):
    for name in set(queries.QUERIES) - set(oracle.SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
