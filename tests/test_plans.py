"""Plan rules for every registered query: no cartesian products or nested-loop joins,
no row-at-a-time Python UDFs, and table scans read only the columns they need."""

import re

import pytest

from tallyspark.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = {name: q.build for name, q in all_queries().items()}


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(build(spark, SF)) for name, build in QUERIES.items()}


def test_no_cross_products(plans):
    bad = [n for n, p in plans.items() if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)]
    assert bad == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


def test_scans_are_pruned(plans):
    # the widest test table is lineitem (11 columns); no query reads all of it
    wide = [n for n, p in plans.items()
            if re.search(r"lineitem\.parquet\]\n(?:.*\n)*?ReadSchema: struct<([^>]*)>", p)
            and any(m.count(":") >= 11 for m in re.findall(r"ReadSchema: struct<([^\n]*)>", p))]
    assert wide == []


def test_python_only_where_designed(plans):
    # Python runs only in bounded groups or per-batch helpers: rating fits, the
    # bootstrap, listing scans and the inference surface
    allowed = {"g10_bt_expected_wins", "g11_calibrated_ratings", "g12_bootstrap_ratings", "g12_bootstrap_draws",
               "g14_bootstrap_leaderboard", "p2_listing_bodies", "u2_infer", "u2_calls_in_flight", "s2_incremental_ratings"}
    python_nodes = ("FlatMapGroupsInPandas", "MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandasWithState")
    used = {n for n, p in plans.items() if any(x in p for x in python_nodes)}
    assert used <= allowed, used - allowed
