"""The driver's contract: entry, queries and their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(frame, columns):
    value = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    rows = [tuple(value(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted([tuple(float(v) if isinstance(v, float) and v.is_integer() else v for v in row) for row in rows], key=repr)


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "k", "value"]
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = contract.queries()[name](spark, SF).toPandas(), duck.sql(contract.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _plain(got, columns) == _plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0
