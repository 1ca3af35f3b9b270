"""Queries whose rows SQL can give too, held against DuckDB over whole tables."""

import duckdb
import pytest

from tidewater.llm import oracles, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DIR), con.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns, plain = sorted(got.columns), lambda r: tuple(map(str, r))
    assert sorted(map(plain, got.select(columns).collect())) == sorted(map(plain, want.select(*columns).fetchall()))
