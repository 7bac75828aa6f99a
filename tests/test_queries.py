"""Registered queries against their check SQL on the smallest data. TESSERA_ALL=1 runs every one."""

from __future__ import annotations

import importlib.util
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUICK = ["index_quarterly_family", "exchange_total_history", "total_return_index", "custom_composite", "validate_prices", "canonical_history", "leaderboard_archive",
         "correlation_pairs", "correlation_clusters", "similarity_join", "research_valuation", "option_grid", "parse_filings", "auction_capture", "story_extreme_movers",
         "sink_archive_checked", "quarterly_rule_backtest", "asof_backward", "calendar_grid", "universe_reconciliation"]

spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()
NAMES = list(CHECKS) if os.environ.get("TESSERA_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    status, rows = check.compare(QUERIES[name](spark, SF), duck, CHECKS[name])
    assert status == "ok" and rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) > 280


@pytest.mark.parametrize("name", ["index_quarterly_family", "exchange_asset_history", "event_priority_dedupe", "similarity_join"])
def test_no_fact_window_in_one_partition(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    for above, below in zip(plan, plan[1:]):
        assert not ("Sort" in above and "SinglePartition" in below), above
    assert not any("CartesianProduct" in line for line in plan)


def test_calendar_grid_reads_its_bounds_once(spark):
    plan = QUERIES["calendar_grid"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("l_shipdate") and sum("Relation" in line and "l_shipdate" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["total_return_constituents", "canonical_index_slice"])
def test_total_return_positions_meet_their_path_where_they_are(spark, name):
    # rows per asset and day are shuffled by asset before they are made, and not again by portfolio and date
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(universe" not in plan and "Generate explode(sequence(" in plan


def test_align_series_builds_its_subject_once(spark):
    # four alignments read one stored series, not the sales four times
    plan = QUERIES["align_series"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "index_level" in plan
