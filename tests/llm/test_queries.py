"""Every corpus query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from vireo.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    own = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    at = [rel.columns.index(c) for c in names]
    other = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(own, key=repr) == sorted(other, key=repr)
