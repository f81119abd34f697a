"""Every named query against its oracle, and the shape of the plans."""

import sys

import duckdb
import pytest

from factloom import catalog

sys.path.insert(0, "tools")
import __spark_entry__ as entry  # noqa: E402
from verify import TABLES, rows_of  # noqa: E402


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "spread" in df.columns
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    p = plan(catalog.QUERIES["sql_filter_having"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_discount,0.05)" in p
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_discount:double,l_shipdate:timestamp_ntz>" in p
    p = plan(catalog.QUERIES["segments"](spark, sf_dir))
    assert "o_orderstatus" not in p


@pytest.mark.parametrize("name", ["segments", "correlations", "hold_lifecycle", "cached_report_lookup", "rank_findings", "asof_join",
                                  "sql_range_join", "sql_subquery", "correlate", "plan_check", "affordability", "describe"])
def test_no_pairing_of_all_rows(spark, sf_dir, name):
    p = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["recent_turns", "cached_report_lookup", "idempotent_grants_batch"])
def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir, name):
    p = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_groupings_share_one_scan(spark, sf_dir):
    p = plan(catalog.QUERIES["categories"](spark, sf_dir))
    assert p.count("FileScan") == 1 and "Expand" in p
