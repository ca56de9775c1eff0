"""Every query of the text operators with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tabverity.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, want.fetchall()))
