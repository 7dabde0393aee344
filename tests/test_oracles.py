"""Every query with SQL against DuckDB on the smallest tables; the others must run and keep their columns."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pulsegrid import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ordered(df):
    names = sorted(df.columns)
    return df[names].sort_values(names).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(core.SQL))
def test_query_equals_sql(spark, duck, name):
    expected, got = ordered(duck.execute(core.SQL[name]).df()), ordered(core.QUERIES[name](spark, SF).toPandas())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=1e-9)


def test_history_is_exported_whole(spark, duck):
    assert core.QUERIES["history_csv_whole"](spark, SF).count() == duck.execute("SELECT count(*) FROM events").fetchone()[0]


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in core.SQL])
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["session", "block", "bpm", "snr_db", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
