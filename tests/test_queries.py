"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tidewater.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        return "" if v is None or str(v) in ("nan", "<NA>", "None") else str(int(v) if isinstance(v, float) and v == int(v) else v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keyset_reaches_the_scan(spark):
    plan = registry.queries()["keyset_page_single"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan" in plan and "TakeOrderedAndProject" in plan
