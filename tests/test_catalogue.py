"""Every query with an SQL form against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = driver.oracle_sql()


def norm(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = driver.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == cols
    assert norm(df.select(*[f"`{c}`" for c in cols]).collect()) == norm([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_entry(spark):
    assert driver.entry(spark).count() == 20


def test_comparison_notices_sabotage(spark, data, duck):
    df = driver.queries()["filter_where_in"](spark, data).limit(3)
    assert norm(df.collect()) != norm(duck.sql(ORACLES["filter_where_in"]).fetchall())
