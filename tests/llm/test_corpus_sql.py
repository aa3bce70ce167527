"""Every corpus query with SQL gives DuckDB's rows on the driver's tables."""

import os

import duckdb
import pytest

from recordlake.llm.catalog import ORACLES, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    found = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
