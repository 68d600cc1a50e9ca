"""The driver's contract: entry, queries and SQL agree on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from larkspur import queries as engine_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_keys_are_never_null(spark, data):
    for t in engine_queries.KEYS:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        assert not df.filter(" or ".join(f"{c} is null" for c in df.columns)).limit(1).count()


@pytest.mark.parametrize("name", sorted(engine_queries.QUERIES))
def test_query_matches_sql(spark, sql, data, name):
    df = entry_module.queries()[name](spark, data)
    text = entry_module.oracle_sql()[name]
    cols = sorted(sql.sql(text).columns)
    assert sorted(df.columns) == cols
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(sql.sql(f"select {', '.join(cols)} from ({text})").fetchall(), key=key)
    assert got == want
