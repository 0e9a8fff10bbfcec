from __future__ import annotations

import hashlib
import math
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortloom.operators import prep, split
from cohortloom.operators.cohort import CohortRule, drop_matching, labelled
from cohortloom.operators.codes import code_pivot
from cohortloom.operators.lookup import add_columns, grouped_category, lookup_first, rows_per_key
from cohortloom.operators.panel import aligned, one_row_per_entity, snapshot_panel, union_panels
from cohortloom.operators.running import running_segments, running_window, with_segment
from cohortloom.operators.summary import any_missing, frequencies, percent_present, profile, rate_by

T0 = datetime(2017, 6, 1, 12)
H = timedelta(hours=1)


def test_snapshot_panel_is_cumulative_and_bounded(spark):
    events = spark.createDataFrame([
        (1, T0, 1, 5.0), (1, T0 + H, 2, 9.0), (1, T0 + H + timedelta(seconds=1), 3, None), (1, T0 + 3 * H, 4, 2.0),
        (1, T0 + 25 * H, 5, 99.0), (1, T0 - H, 6, 77.0), (2, T0 + 20 * H, 7, 4.0),
    ], "k long, ts timestamp, id long, v double")
    anchors = spark.createDataFrame([(1, T0), (2, T0)], "k long, t0 timestamp")
    got = snapshot_panel(events, anchors, ["k"], ts="ts", anchor="t0", tie="id", measures={"v": F.col("v")}, hours=(1, 3, 24))
    assert rows(got, "k", "hour") == [
        (1, 1, 2, 5.0, 9.0, 5.0, 9.0, 7.0, 4.0),
        (1, 3, 4, 5.0, 2.0, 2.0, 9.0, 16 / 3, -3.0),
        (1, 24, 4, 5.0, 2.0, 2.0, 9.0, 16 / 3, -3.0),
        (2, 1, 0, None, None, None, None, None, None),
        (2, 3, 0, None, None, None, None, None, None),
        (2, 24, 1, 4.0, 4.0, 4.0, 4.0, 4.0, 0.0),
    ]
    hot = snapshot_panel(events, anchors, ["k"], ts="ts", anchor="t0", tie="id", measures={"v": F.col("v")}, hours=(1, 3, 24), hot_rows=2)
    assert rows(hot, "k", "hour") == rows(got, "k", "hour")


def test_union_by_name_and_by_template(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("y", 2)], "s string, n int")
    assert rows(union_panels([a, b]), "n") == [(1, "x"), (2, "y")]
    assert aligned(spark.createDataFrame([(3, "z")], "N int, S string"), a).columns == ["n", "s"]


def test_one_row_per_entity_uses_available_hours(spark):
    panel = spark.createDataFrame([(k, h) for k in range(200) for h in ((1, 3, 6, 12, 24) if k else (6,))], "k long, hour int")
    drawn = rows(one_row_per_entity(panel, ["k"], "hour", 3), "k")
    assert len(drawn) == 200 and drawn[0] == (0, 6)
    assert {h for _, h in drawn} == {1, 3, 6, 12, 24}
    assert rows(one_row_per_entity(panel.repartition(13), ["k"], "hour", 3), "k") == drawn


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank_is_the_rank_in_hash_order(spark, digits):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 3, 1).when(F.col("id") < 900, 0).alias("y"))
    got = {r["k"]: (r["rank"], r["stratum_size"]) for r in split.hash_rank(df, "k", ["y"], 9, digits=digits).collect()}
    for members in (range(3), range(3, 900), range(900, 1000)):
        order = sorted(members, key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
        assert [got[k] for k in order] == [(i + 1, len(order)) for i in range(len(order))]


def test_stratified_split_shares_and_stability(spark):
    df = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("k"), (F.col("id") < 3).cast("int").alias("y"))
    s = split.stratified_split(df, "k", "y", 124800, 0.7)
    assert rows(s.groupBy("y", "is_train").count(), "y", "is_train") == [(0, False, 299), (0, True, 698), (1, True, 3)]
    assert rows(split.stratified_split(df.orderBy(F.rand(1)).repartition(11), "k", "y", 124800, 0.7), "k") == rows(s, "k")
    panel = df.select("k", F.explode(F.array(F.lit(1), F.lit(6))).alias("hour"))
    assert split.train_rows(panel, s, "k").count() == 2 * 701 and split.test_rows(panel, s, "k").count() == 2 * 299


def test_folds_are_even_per_class(spark):
    df = spark.range(103).select(F.col("id").alias("k"), (F.col("id") < 13).cast("int").alias("y"))
    sizes = rows(split.stratified_folds(df, "k", "y", 1, 5).groupBy("y", "fold").count(), "y", "fold")
    assert [n for y, _, n in sizes if y == 1] == [3, 3, 3, 2, 2] and [n for y, _, n in sizes if y == 0] == [18] * 5


def test_half_split_parts_do_not_overlap(spark):
    a, b = split.half_split(spark.range(1000), "id", 5)
    assert a.count() + b.count() == 1000 and 440 < a.count() < 560 and a.intersect(b).count() == 0


def test_running_segments_equal_one_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("t"), (F.col("id") % 5).alias("v"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("m"))
    plain = running_window(df, ["g"], ["t"], ["v"], ["m"])
    for edges in ([100.0, 250.0, 400.0], [-5.0, 1000.0], []):
        cut = running_segments(with_segment(df, "t", edges), ["g"], ["t"], ["v"], ["m"]).select(*df.columns)
        assert rows(cut, "g", "t") == rows(plain, "g", "t")


def test_running_segments_shuffle_the_rows_once(spark):
    df = spark.range(500).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 500).alias("t"), F.col("id").alias("row"), F.when((F.col("id") % 50 < 2) & (F.col("id") > 20), F.struct("id")).alias("m"))
    placed = with_segment(df, "t", [100.0, 250.0, 400.0])
    want = rows(running_window(df, ["g"], ["t"], [], ["m"]), "row")
    for valued in (None, placed.filter("m is not null")):
        cut = running_segments(placed, ["g"], ["t"], maxes=["m"], valued=valued).select(*df.columns)
        assert rows(cut, "row") == want
        # the sort carries the rows, no join sorts them again
        assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_mode_imputation(spark):
    df = spark.createDataFrame(
        [("b", None, 1.0, "x"), ("a", None, None, "x"), (None, None, 2.0, "y"), ("a", None, 3.0, None), ("b", None, 4.0, "x")],
        "tie string, empty string, num double, m string",
    )
    learned = prep.fit_modes(df, ["tie", "empty", "num", "m"])
    assert learned == {"tie": "a", "m": "x"}
    out = prep.impute_modes(df, learned)
    assert out.filter("tie is null or m is null").count() == 0 and out.filter("num is null").count() == 1


def test_new_levels_and_indicators(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,), ("c",)], "c string")
    levels = prep.fit_levels(train, ["c"])
    assert levels == {"c": ["a", "b", "c"]}
    coded = prep.one_hot(prep.bucket_new_levels(new, levels), levels)
    assert coded.columns == ["c_b", "c_c", "c_new"]
    assert [tuple(r) for r in coded.collect()] == [(0, 0, 0), (0, 0, 1), (None, None, None), (0, 1, 0)]
    with pytest.raises(ValueError):
        prep.fit_levels(train, ["c"], max_levels=2)


def test_feature_vectors_have_a_bucket_for_unseen_and_missing(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b")], "n double, c string")
    model = prep.feature_pipeline(["n"], ["c"]).fit(train)
    new = spark.createDataFrame([(5.0, "b"), (6.0, "z"), (7.0, None)], "n double, c string")
    got = [list(r[0].toArray()) for r in model.transform(new).select("features").collect()]
    assert got == [[5.0, 0.0, 1.0, 0.0], [6.0, 0.0, 0.0, 1.0], [7.0, 0.0, 0.0, 1.0]]


def test_rare_levels_are_pooled(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 7 + [("c",)] * 3 + [(None,)], "c string")
    common = prep.fit_common_levels(df, "c", 0.05)
    assert common == ["a", "b"]
    assert rows(prep.pool_rare(df, "c", common).groupBy("c").count(), "c") == [(None, 1), ("a", 90), ("b", 7), ("other", 3)]


def test_guards(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("x", 1, 2)], "s string, n long, extra int")
    report = {r["column"]: tuple(r)[1:] for r in prep.schema_report(a, b).collect()}
    assert report == {"n": (True, True, False, False), "s": (True, True, True, False), "extra": (False, True, False, False)}
    with pytest.raises(ValueError):
        prep.check_columns(a, ["n", "gone"])
    assert prep.check_missing(a, ["n"]).count() == 1
    with pytest.raises(Exception, match="missing value in n"):
        prep.check_missing(spark.createDataFrame([(None,)], "n int"), ["n"]).collect()


def test_code_pivot_does_not_fan_out(spark):
    facts = spark.createDataFrame([
        (1, "A", "N"), (1, "A", "Y"), (1, "B", "U"), (2, "A", "U"), (3, "Z", "Y"), (4, "B", "E"), (4, "B", "N"),
    ], "k int, code string, poa string")
    got = code_pivot(facts, ["k"], "code", {"a": ["A"], "b": ["B"]}, present="poa")
    assert rows(got, "k") == [(1, 1, 1, 1, None), (2, 1, None, 0, None), (4, 0, None, 1, 1)]


def test_lookup_takes_the_first_match(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "q"), (4, None)], "i int, code string")
    mapping = spark.createDataFrame([("a", "SELF PAY", None, 2), ("a", "other", "late", 3), ("b", "X", "mine", 1), (None, "n", "n", 0)], "k string, base string, override string, o int")
    assert rows(lookup_first(df, mapping, on="code", key="k", take={"v": "base"}, order=["o"]).select("i", "v"), "i") == [(1, "SELF PAY"), (2, "X"), (3, None), (4, None)]
    got = grouped_category(df, mapping, on="code", key="k", base="base", override="override", out="cat", order=["o"])
    assert rows(got.select("i", "cat"), "i") == [(1, "self pay"), (2, "mine"), (3, "other"), (4, None)]


def test_add_columns_and_fan_out(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    right = spark.createDataFrame([(1, "other", 5)], "k int, s string, n int")
    assert rows(add_columns(left, right, ["k"]), "k") == [(1, "a", 5), (2, "b", None)]
    assert rows(rows_per_key(left.union(left.filter("k = 1")), ["k"]), "rows_per_key") == [(1, 1), (2, 1)]


def test_cohort_rule_rejects_missing_values(spark):
    rule = CohortRule("2016-01-01", "2017-12-01", facility_type="Acute", excluded_groups=["GONE"], excluded_facilities=["X"], source_system="S")
    f = spark.createDataFrame([("Acute", "g", "A"), ("Acute", None, "A"), ("Acute", "GONE", "A"), ("Acute", "g", "X"), (None, "g", "A"), ("Rehab", "g", "A")], "kind string, grp string, code string")
    assert f.filter(rule.facilities(kind="kind", group="grp", code="code")).count() == 1
    v = spark.createDataFrame([
        (1, 0, 18.0, datetime(2016, 1, 1), "S"), (0, 1, 17.9, datetime(2016, 5, 1), "S"), (0, 0, 50.0, datetime(2016, 5, 1), "S"),
        (0, 1, 50.0, datetime(2017, 12, 1), "S"), (0, 1, 50.0, datetime(2017, 12, 2), "S"), (0, 1, 50.0, datetime(2016, 5, 1), "T"),
    ], "ed int, ip int, age double, out timestamp, src string")
    assert v.filter(rule.visits(ed="ed", ip="ip", age="age", discharge="out", source="src")).count() == 2


def test_drop_by_pattern_and_labels(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "id int, a_ts_x int, b_dt_tm int, time1 int, kept int")
    assert drop_matching(df, ["(_ts)|(dt_tm)$", "time[12]$"], ["id"]).columns == ["kept"]
    assert labelled(df, {"kept": "Kept value"}).schema["kept"].metadata == {"label": "Kept value"}


def test_summaries(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 0, "x"), ("b", 1, "x"), ("c", 1, "y"), ("c", 0, None)], "g string, y int, v string")
    rates = {r["g"]: r for r in rate_by(df, ["g"], "y").collect()}
    assert (rates["a"]["rate"], rates["a"]["lower"], rates["a"]["upper"]) == (0, 0, 0)
    assert (rates["b"]["n"], rates["b"]["rate"], rates["b"]["upper"]) == (1, 1, 1)
    assert rates["c"]["upper"] == pytest.approx(0.5 + 1.959963984540054 * math.sqrt(0.25 / 2))
    assert rows(profile(df, ["g", "v"]), "column") == [("g", 5, 0, 3), ("v", 3, 2, 2)]
    assert [(c, v, n, round(p, 6)) for c, v, n, p in rows(frequencies(df, ["v"]), "value")] == [("v", "x", 2, 0.666667), ("v", "y", 1, 0.333333)]
    assert rows(any_missing(df, ["g", "v"])) == [(False, True)]
    marked = spark.createDataFrame([("p", 1), ("p", 1), ("p", 0), ("p", None), ("q", None)], "c string, poa int")
    assert rows(percent_present(marked, ["c"], F.col("poa")), "c") == [("p", 4, 67.0), ("q", 1, None)]


def test_formula_and_column_order(spark):
    df = spark.createDataFrame([(1.0, "a", 0.0), (2.0, "b", 1.0)], "n double, c string, y double")
    out = prep.formula("y", ["n", "c"]).fit(df).transform(df)
    assert out.select("features", "label").first()["label"] == 0.0 and len(out.first()["features"]) >= 2
    assert prep.ordered_like(df.select("y", "c", "n"), df).columns == ["n", "c", "y"]


def test_many_classes_are_split_alike(spark):
    df = spark.range(3000).select("id", (F.col("id") % 300).alias("y"))
    taken = split.stratified_split(df, "id", "y", 1, 0.7).groupBy("y").agg(F.count_if("is_train").alias("n")).collect()
    assert len(taken) == 300 and {r["n"] for r in taken} == {7}
    folds = split.stratified_folds(df, "id", "y", 1, 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 1500 and {r["count"] for r in folds} == {2}
