"""Every query against its SQL, on all rows of the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from graphloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = [[None if x is None or x is pd.NA or x != x else x for x in frame[c].tolist()] for c in frame.columns]
    return sorted(zip(*plain, strict=True), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["inst", "query", "task", "targets", "difficulty"] and out.count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
