from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortloom.operators.pointintime import band_join, first_state, match_audit, near_any_anchor, state_at
from cohortloom.operators.skew import hot_keys, salted_join

T0 = datetime(2017, 6, 1, 12)
H = timedelta(hours=1)
US = timedelta(microseconds=1)


def test_state_at_is_strict_on_both_ends(spark):
    probe = T0 + 3 * H
    anchors = spark.createDataFrame([(k, T0) for k in "abcdefg"], "k string, t0 timestamp")
    intervals = spark.createDataFrame([
        ("a", probe, probe + H, "starts at the probe"),
        ("b", T0, probe, "ends at the probe"),
        ("c", T0, probe + US, "spans"),
        ("d", T0, None, "open"),
        ("e", T0 + H, probe + H, "later"), ("e", T0, probe + 2 * H, "earlier"),
        ("f", T0, T0 + H, "before"),
    ], "k string, s timestamp, e timestamp, w string")
    got = state_at(anchors, intervals, ["k"], anchor="t0", hours=3, start="s", end="e", tie=["w"])
    assert rows(got.select("k", "w"), "k") == [("c", "spans"), ("e", "earlier")]


def test_band_join_excludes_its_ends(spark):
    anchors = spark.createDataFrame([("a", T0)], "k string, t0 timestamp")
    times = [T0 - 24 * H, T0 - 24 * H + US, T0, T0 + 24 * H - US, T0 + 24 * H]
    events = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)] + [("b", T0, 9)], "k string, t timestamp, i int")
    got = band_join(events, anchors, ["k"], ts="t", anchor="t0", tie="i")
    assert sorted(r["i"] for r in got.collect()) == [1, 2, 3]


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_near_any_anchor_equals_brute_force(spark, hot_rows):
    rng = random.Random(5)
    events = [(rng.choice("aaab"), T0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 30, 30)), i) for i in range(300)]
    anchors = [(rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 30, 30))) for _ in range(6)]
    expected = sorted(i for k, t, i in events if any(a == k and abs(t - x) < 24 * H for a, x in anchors))
    got = near_any_anchor(
        spark.createDataFrame(events, "k string, t timestamp, i int"), spark.createDataFrame(anchors, "k string, t0 timestamp"),
        ["k"], ts="t", anchor="t0", tie="i", hot_rows=hot_rows,
    )
    assert sorted(r["i"] for r in got.collect()) == expected and 0 < len(expected) < 300


def test_salted_join_equals_plain_join(spark):
    many = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(90)] + [(None, 99)], "k string, i int")
    one = spark.createDataFrame([("hot", "h"), ("k1", "x"), ("k2", "y"), (None, "n")], "k string, v string")
    assert [r["k"] for r in hot_keys(many, ["k"], 20).collect()] == ["hot"]
    assert hot_keys(many, ["k"], 1000) is None
    for how in ("inner", "left"):
        a = salted_join(many, one, ["k"], spread_on=["i"], how=how, min_rows=20)
        b = many.join(one, "k", how)
        assert sorted(map(str, rows(a.select("k", "i", "v")))) == sorted(map(str, rows(b.select("k", "i", "v"))))


def test_first_state_and_audit(spark):
    df = spark.createDataFrame([("a", T0 + H, "x"), ("a", T0, "y"), ("b", None, "z")], "k string, s timestamp, w string")
    assert rows(first_state(df, ["k"], start="s", tie=["w"], keep={"first": "w"}), "k") == [("a", "y"), ("b", "z")]
    left = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", T0)], "k string, l timestamp")
    right = spark.createDataFrame([("a", T0), ("b", T0 + H), ("c", T0 - H)], "k string, r timestamp")
    assert rows(match_audit(left, right, ["k"], left_ts="l", right_ts="r")) == [(4, 1, 1, 1, 1)]


def test_joins_stay_equi_joins(spark):
    anchors = spark.createDataFrame([("a", T0)], "k string, t0 timestamp")
    intervals = spark.createDataFrame([("a", T0, T0 + H, "w")], "k string, s timestamp, e timestamp, w string")
    frames = [
        state_at(anchors, intervals, ["k"], anchor="t0", hours=3, start="s", end="e", tie=["w"]),
        near_any_anchor(intervals.withColumn("i", F.lit(1)), anchors, ["k"], ts="s", anchor="t0", tie="i"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
