"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        if isinstance(v, list | tuple):
            return tuple(one(x) for x in v)
        return repr(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({SQL[name]})")
    assert sorted(duck.sql(SQL[name]).columns) == columns
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want.fetchall())


def test_entry_has_rows_and_all_sql_has_a_query(spark):
    assert entry.entry(spark).columns == ["qid", "chunk_id", "score", "rn"]
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["louvain", "community_summaries", "zero_shot"])
def test_other_queries_run(name, spark, sf):
    assert queries.queries()[name](spark, sf).count() > 0
