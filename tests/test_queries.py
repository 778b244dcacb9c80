"""Every registered query against DuckDB on the smallest data, and plan properties at scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from hazeline.plans.oracles import ORACLES
from hazeline.plans.registered import QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    return duck(SF)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert compare(entry_point.queries()[name](spark, SF), entry_point.oracle_sql()[name], db) == []


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry_point.queries())


def test_a_planted_error_is_seen(spark, db):
    assert compare(entry_point.queries()["api_summary"](spark, SF), "SELECT source_ AS source, 1 AS success, 1 AS failed FROM (VALUES ('x')) t(source_)", db)


@pytest.mark.parametrize("name", ["fuse_daily", "dedup_first", "dedup_lineitem", "upsert_latest"])
def test_losers_are_dropped_before_the_exchange(spark, name):
    text = plan(entry_point.queries()[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    before = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before and "Partial" in before


@pytest.mark.parametrize("name", ["call_status", "bronze", "call_log", "null_tokens", "sentinels", "standardized", "lineage", "feature_projection"])
def test_narrow_queries_have_no_exchange(spark, name):
    assert "Exchange" not in plan(entry_point.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["live_spine", "date_spine", "landing_gaps", "run_summary", "fuse_daily"])
def test_no_cross_joins(spark, name):
    text = plan(entry_point.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_asked_for(spark):
    text = plan(entry_point.queries()["api_summary"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_dimension_is_read_once_for_each_lookup(spark):
    """No self join of the dimension, and no job while the plan is built."""
    text = plan(entry_point.queries()["dim_join"](spark, SF))
    assert text.count("SortMergeJoin") <= 1 and text.count("FileScan") <= 11  # one is left to the run time's sizes
