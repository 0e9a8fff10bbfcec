"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return physical(entry.queries()[name](spark, FOLDER))


def test_history_reads_each_side_once_and_builds_no_pairs(spark):
    text = plan(spark, "history_features")
    assert text.count("orders.parquet") == 2 and text.count("lineitem.parquet") == 1
    assert "patient_id" not in "".join(line for line in text.splitlines() if "Join" in line)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "exposure_chain")
    lines = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "EqualTo(l_linestatus,F)" in lines and "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in lines
    assert "l_comment" not in lines and "l_extendedprice" not in lines
    text = plan(spark, "column_profile")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text


@pytest.mark.parametrize("name", ["dedupe_first", "first_event_per_entity", "lookup_first_match"])
def test_first_row_is_cut_down_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and re.search(r"row_number\(\), 1, Partial", text)


@pytest.mark.parametrize("name", ["code_flags_pivot", "text_order_first", "snapshot_panel", "rate_by_age_band", "confusion", "threshold_sweep", "column_profile"])
def test_aggregates_are_combined_before_the_shuffle(spark, name):
    assert re.search(r"partial_(max|min|count|sum|avg)", plan(spark, name))


def test_split_moves_no_entity(spark):
    from cohortloom.operators.split import stratified_split

    df = spark.range(100).selectExpr("id AS k", "id % 2 AS y")
    text = physical(stratified_split(df, "k", "y", 1))
    assert "BroadcastExchange" in text and not re.search(r"(?<!Broadcast)Exchange", text)  # only the cut points are sent


def test_snapshot_panel_needs_no_sort_before_the_shuffle(spark):
    text = plan(spark, "snapshot_panel")
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_curves_read_their_input_once(spark, monkeypatch):
    from cohortloom.operators import curve

    stored = []
    monkeypatch.setattr(curve, "written_once", lambda df: stored.append(df) or written(df))
    written = __import__("cohortloom.session", fromlist=["written_once"]).written_once
    text = plan(spark, "auc_by_hour")
    assert len(stored) == 1 and physical(stored[0]).count("orders.parquet") == 1 and "orders.parquet" not in text


def test_thresholds_and_confusion_need_no_window(spark):
    for name in ("threshold_sweep", "metric_bundle", "confusion", "at_thresholds"):
        text = plan(spark, name)
        assert "Window" not in text and "Expand" not in text
