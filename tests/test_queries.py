"""Every registered query against its DuckDB text on the given tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{SF_DIR}/{file}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, "" if v is None else v) for v in r))


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    got = [tuple(row) for row in df.select(*columns).collect()]
    assert len(got) == len(want) > 0
    assert ordered(got) == ordered(want)


def test_entry(spark):
    assert entry(spark).columns[:4] == ["circuit", "race_number", "vehicle_id", "telemetry_name"]


def test_page_filters_reach_the_scan(spark):
    plan = queries()["gear_usage"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(circuit" in plan
    assert "PushedFilters: [IsNotNull(gear)]" in plan
    assert "ReadSchema: struct<gear:double>" in plan


def test_periods_shuffle_their_rows_once(spark):
    """Rows are exchanged by chunk and series, not by series, and the second branch reuses it."""
    df = queries()["value_periods_all_signals"](spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
    assert plan.count("FileScan parquet") == 1
