"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    want = cur.fetchall()
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in cur.description], want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
