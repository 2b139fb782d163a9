"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names, order-insensitive value digest)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

# Those of the optional subpackage have tests of their own.
QUERIES = {k: f for k, f in E.queries().items() if not f.__module__.startswith(("stratum.llm", "corpus_pipeline"))}
ORACLE = {k: s for k, s in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["region", "month", "unique_buyers", "total_revenue", "revenue_per_buyer"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert len(rows) > 0
        return
    rel = con.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]
