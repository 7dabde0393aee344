"""Registered queries against their SQL: on the smallest tables, and on small ones with odd rows."""

import os

import duckdb
import pandas as pd
import pytest

from pulsegrid.llm import queries

SF = "/root/testdata/sf0.001"


def both(spark, name, folder, tables):
    with duckdb.connect() as con:
        for table in tables:
            path = f"{folder}/{table}.parquet"
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        expected = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, folder).toPandas()
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    return (df[names].sort_values(names).reset_index(drop=True) for df in (got, expected))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, expected = both(spark, name, SF, ["documents", "pages", "embeddings"])
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=0)


@pytest.mark.parametrize("name", ["op3_pii", "op10_setsketch_dedup"])
def test_odd_rows_equal_sql(spark, name, tmp_path):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Alone"), (5, "aLONE"), (6, "a b"), (7, "ÄB äb"), (8, "äB äb")]
    # a chain: each text shares over 80 % with the next, not with those further on
    rows += [(10 + k, " ".join(base[3 * k :] + [f"x{j}" for j in range(3 * k)])) for k in range(8)]
    rows += [(30, "Mail ann.lee@example.com, bob@x.org or 10.0.0.1, 300.1.1.1 and 4111 1111 1111 1111 zebra"), (31, "zebra ann.lee@example.com +44 (20) 1234-5678 quagga")]
    rows += [(32, "é😀 quagga +44 2012345678, 1.2.3.4.5 a@b.c@d.e"), (33, "4111-1111-1111-1112 5500005555555559" * 40), (34, "plain " * 5_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, expected = both(spark, name, str(tmp_path), ["documents"])
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=0)
