"""Registered queries against their SQL twins, and shape checks on the plans.

By default a spread of queries runs at the smallest scale; FULL_CHECK=1 runs all.
"""

import os
import re

import pytest

import __spark_entry__ as entry_module
from queryset import check
from queryset import fixtures as fx
from queryset import queries as q

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "src_definition_parts", "src_refresh_history", "sink_calls", "sink_validation", "preview_capped", "expr_route_by_type",
    "strings_for_key", "mask_strings", "calls_all", "redact_secrets", "activity_calls", "portal_link", "skip_reason",
    "kpi_cards", "tenant_rollup", "no_new_refresh", "baseline_reset", "scan_event", "pending_retries", "reach_from_log",
    "duration_percentiles", "clones_wide", "stream_latest_run", "stream_first_terminal", "estate_scan",
    "refreshes_around", "first_rules", "adoption_approx", "stream_late_rows", "sink_snapshot", "expr_join_lines",
    "ref_migration_table", "value_rollup", "connector_groups", "scan_record", "arg_window",
]
NAMES = list(entry_module.oracle_sql()) if os.environ.get("FULL_CHECK") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.sql_engine(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) == ""


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expression_scan_does_not_shuffle(spark):
    text = plan(q.calls.scan_expressions(spark.createDataFrame([("a", "b")], "id string, expression string")))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert len(re.findall("BroadcastHashJoin", text)) == 2


def test_latest_row_queries_reduce_before_the_exchange(spark):
    for name in ("recent_refreshes", "preferred_call", "workspace_progress", "last_n_log"):
        assert re.search(r"WindowGroupLimit.*Partial", plan(q.QUERIES[name](spark, FOLDER))), name


def test_scans_read_only_their_columns(spark):
    text = plan(q.QUERIES["kinds_summary"](spark, FOLDER))
    assert "p_name" not in text and "p_retailprice" not in text
    text = plan(fx.refresh_history(spark, FOLDER).select("item_id"))
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_no_cross_joins(spark):
    for name in ("counts_by_risk_per_workspace", "connections_top10", "activity_calls", "estate_scan", "reach"):
        assert "CartesianProduct" not in plan(q.QUERIES[name](spark, FOLDER)), name
