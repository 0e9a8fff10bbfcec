"""Many instants per key, pairs in a band, level tables, observed loads and numeric profiles against plain versions, and edge cases."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import levels
from cohortloom.operators.guard import Limits, LoadError, fan_out_keys, observed_write
from cohortloom.operators.levels import LevelTable
from cohortloom.operators.prep import MAX_LEVELS
from cohortloom.operators.profile import numeric_profile
from cohortloom.operators.timeline import band_pairs, states_at

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_states_of_overlapping_intervals(spark, hot_rows):
    r = random.Random(5)
    stays = [(r.choice(["a", "a", "b"]), T0 + timedelta(hours=(s := r.randrange(60))), None if r.random() < 0.1 else T0 + timedelta(hours=s + r.randrange(-2, 25)), k) for k in range(60)]
    asks = [(k, key, T0 + timedelta(hours=h)) for k, (key, h) in enumerate((key, h) for key in ("a", "b", "c", None) for h in range(0, 90, 3))] + [(999, "a", None)]
    intervals = spark.createDataFrame(stays, "key string, start timestamp, end timestamp, id long")
    probes = spark.createDataFrame(asks, "probe long, key string, at timestamp")
    found = states_at(probes, intervals, ["key"], at="at", start="start", end="end", tie="id", hot_rows=hot_rows)
    assert "Join" not in plan(found).split("== Optimized")[0] or hot_rows == 15

    def first(key, at):
        open_ = [(s, -e.timestamp(), i) for k, s, e, i in stays if at is not None and k == key and e is not None and s < at < e]
        return min(open_)[2] if open_ else None

    assert {x.probe: x.id for x in found.collect()} == {p: first(key, at) for p, key, at in asks}


def test_states_at_in_segments_moves_no_probe_through_a_join(spark):
    intervals = spark.range(300).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 7919 % 300 * 60).alias("start"), F.timestamp_seconds(F.col("id") * 7919 % 300 * 60 + 900).alias("end"), "id")
    probes = spark.range(600).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 37).alias("at"), F.col("id").alias("probe"))
    more = {"at": "at", "start": "start", "end": "end", "tie": "id"}
    cut = states_at(probes, intervals, ["key"], **more, hot_rows=20)
    assert "Join" not in plan(cut).split("== Physical")[0]
    assert cut.exceptAll(states_at(probes, intervals, ["key"], **more)).count() == 0 and cut.count() == 600


def test_no_probes_and_no_intervals(spark):
    intervals = spark.createDataFrame([], "key string, start timestamp, end timestamp, id long")
    probes = spark.createDataFrame([(1, "a", T0)], "probe long, key string, at timestamp")
    more = {"at": "at", "start": "start", "end": "end", "tie": "id"}
    assert [tuple(r) for r in states_at(probes, intervals, ["key"], **more).collect()] == [(1, "a", T0, None, None, None)]
    assert states_at(probes.limit(0), intervals, ["key"], **more).count() == 0


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_band_pairs_are_made_once(spark, hot_rows):
    r = random.Random(6)
    events = [(k, r.choice("ab"), T0 + timedelta(minutes=r.randrange(5000))) for k in range(80)] + [(80, "a", None)]
    anchors = [(k, r.choice("ab"), T0 + timedelta(minutes=r.randrange(5000))) for k in range(40)]
    got = band_pairs(
        spark.createDataFrame(events, "event long, key string, ts timestamp"), spark.createDataFrame(anchors, "anchor_id long, key string, anchor timestamp"),
        ["key"], ts="ts", anchor="anchor", tie="event", hours=7, hot_rows=hot_rows,
    )
    want = sorted((e, a) for e, k, t in events for a, x, s in anchors if k == x and t is not None and abs(t - s) < timedelta(hours=7))
    assert sorted((x.event, x.anchor_id) for x in got.collect()) == want


def test_level_table_holds_more_levels_than_the_driver_would(spark):
    n = MAX_LEVELS + 500
    rows = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("wide"), F.when(F.col("id") % 3 > 0, "hot").alias("narrow"), F.lit(2.0).alias("x"))
    found = LevelTable(rows, ["x"], ["wide", "narrow"], hot_rows=1000)
    assert found.size == 1 + n + 1 + 1 + 1 and found.table.count() == n + 1
    slots = {r.level: r.slot for r in found.table.collect()}
    assert [slots[v] for v in sorted(f"v{k}" for k in range(n))] == list(range(1, n + 1)) and slots["hot"] == n + 2
    got = {r.id: r for r in found.matrix(rows.limit(4), ["id"]).collect()}
    assert got[0].slots == [0, slots["v0"], n + 3] and got[1].slots == [0, slots["v1"], n + 2] and got[1]["values"] == [2.0, 1.0, 1.0] and got[0].size == found.size
    assert found.names().count() == found.size


def test_new_and_missing_levels_and_numbers(spark):
    train = spark.createDataFrame([(1, 0.0, "b", "="), (2, 1.5, "a", ""), (3, None, None, "x")], "id long, x double, c string, d string")
    found = LevelTable(train, ["x"], ["c", "d"])
    rows = spark.createDataFrame([(7, 0.0, "a", "="), (8, None, "zz", None), (9, 3.0, None, "")], train.schema)
    got = {r.id: (r.slots, r["values"]) for r in found.matrix(rows, ["id"]).collect()}
    # x | a b new | '' = x new
    assert got[7] == ([1, 5], [1.0, 1.0]) and got[9] == ([0, 3, 4], [3.0, 1.0, 1.0])
    assert got[8][0] == [0, 3, 7] and got[8][1][0] != got[8][1][0]
    assert LevelTable(train.limit(0), [], ["c"]).matrix(rows, ["id"]).first().slots == [0]


def test_ranks_run_over_tasks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v")).repartition(7)
    got = {(r.g, r.v): r["rank"] for r in levels.ranked(df, "g", "v").collect()}
    for g in range(3):
        assert [got[x] for x in sorted(k for k in got if k[0] == g)] == list(range(sum(k[0] == g for k in got)))


def test_figures_are_gathered_in_the_job_that_writes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "key long, v string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    load = observed_write(df.mapInArrow(counted, df.schema), Limits(least_rows=3, most_missing={"v": 0.5}, checks={"key": F.col("key") > 0}), ranges=["key"])
    assert reads.value == 3 and load.rows.count() == 3 and reads.value == 3
    assert dict(load.figures) == {"rows": 3, "missing v": 1, "least key": "1", "greatest key": "2", "broken key": 0}


def test_a_load_outside_its_limits_stops(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (-2, None)], "key long, v string")
    limits = Limits(least_rows=4, most_missing={"v": 0.5}, checks={"key": F.col("key") > 0})
    with pytest.raises(LoadError) as e:
        observed_write(df, limits)
    assert set(e.value.broken) == {"rows", "missing v", "key"}


def test_fan_out_is_counted_and_its_keys_are_named(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "x")], "key long, v string")
    load = observed_write(left, join=(right, ["key"]))
    assert load.figures["rows_before_join"] == 3 and load.figures["fan_out"] == 2
    assert [tuple(r) for r in fan_out_keys(right, ["key"]).collect()] == [(1, 3)]


@pytest.mark.parametrize("segment_rows", [10_000, 7])
def test_numeric_profile_equals_a_plain_version(spark, segment_rows):
    r = random.Random(8)
    a = [float(r.randrange(30)) for _ in range(101)]
    rows = [(x, None if k % 4 else r.gauss(0, 1), 5.0) for k, x in enumerate(a)] + [(float("nan"), None, 5.0)]
    got = {x.column: x for x in numeric_profile(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], segment_rows=segment_rows).collect()}
    for name, values in (("a", a), ("b", [x[1] for x in rows if x[1] is not None]), ("c", [5.0] * 102)):
        x, n = got[name], len(values)
        cuts = statistics.quantiles(values, n=20, method="inclusive")
        assert (x.n, x.missing, x.distinct) == (n, 102 - n, len(set(values)))
        assert [x.q05, x.q25, x.q50, x.q95] == pytest.approx([cuts[0], cuts[4], cuts[9], cuts[18]])
        assert x.mean == pytest.approx(statistics.fmean(values))
        assert x.gmd == pytest.approx(sum(abs(p - q) for p in values for q in values) / (n * (n - 1)))
        assert x.info == pytest.approx((1 - sum((values.count(v) / n) ** 3 for v in set(values))) / (1 - 1 / n**2))
        assert x.lowest == sorted(set(values))[:5] and x.highest == sorted(set(values))[-5:]


def test_profile_of_nothing(spark):
    x = numeric_profile(spark.createDataFrame([(None,), (None,)], "a double"), ["a"]).first()
    assert (x.n, x.missing, x.distinct, x["mean"], x.q50, x.lowest) == (0, 2, 0, None, None, None)
