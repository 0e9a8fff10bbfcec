from __future__ import annotations

import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortloom.operators import evaluate as ev
from cohortloom.operators.curve import threshold_curve


def frame(spark, pairs):
    return spark.createDataFrame([(float(s) if s is not None else None, y) for s, y in pairs], "s double, y int")


def c_of(df):
    return ev.c_statistic(df, "s", "y").first()


@pytest.mark.parametrize("tp, fp, fn, tn, expected, interval", [
    (92, 4218, 18, 28998,
     dict(accuracy=.8729, kappa=.0354, sens=.836364, spec=.873013, ppv=.021346, npv=.999380, prevalence=.003301, detection_rate=.002761,
          detection_prevalence=.129328, balanced_accuracy=.854688, no_information_rate=.9967), (.8693, .8765)),
    (95, 9962, 15, 23254,
     dict(accuracy=.7006, kappa=.0122, sens=.863636, spec=.700084, ppv=.009446, npv=.999355, prevalence=.003301, detection_rate=.002851,
          detection_prevalence=.301776, balanced_accuracy=.781860, no_information_rate=.9967), (.6957, .7055)),
])
def test_confusion_golden(spark, tp, fp, fn, tn, expected, interval):
    stats = ev.exact_tests(ev.confusion_stats(spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long"))).first()
    for name, value in expected.items():
        digits = 4 if name in ("accuracy", "kappa", "no_information_rate") else 6
        assert round(stats[name], digits) == value, name
    assert (round(stats["accuracy_lower"], 4), round(stats["accuracy_upper"], 4)) == interval
    assert stats["p_accuracy_above_nir"] == pytest.approx(1) and stats["p_mcnemar"] < 2e-16


def test_exact_interval_against_direct_sums():
    for k, n in ((0, 7), (3, 10), (10, 10), (45, 60)):
        low, high = ev._exact_interval(k, n)
        tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)
        if k:
            assert tail(low, range(k, n + 1)) == pytest.approx(0.025, abs=1e-9)
        if k < n:
            assert tail(high, range(k + 1)) == pytest.approx(0.025, abs=1e-9)
        assert ev._upper_tail(k, n, 0.4) == pytest.approx(tail(0.4, range(k, n + 1)))


def test_limits_of_large_counts_come_from_the_fraction(monkeypatch):
    # by the fraction, in doubles; a normal form differs in the 11th digit
    assert ev._exact_interval(30_000_000, 60_000_000)[0] == pytest.approx(0.4998734765393, abs=5e-13)
    low, high = ev._exact_interval(870_000, 1_000_000)
    assert low < 0.87 < high and ev._beta_cdf(low, 870_000, 130_001) == pytest.approx(0.025, abs=1e-9)
    monkeypatch.setattr(ev, "MOST_STEPS", 5)
    with pytest.raises(ArithmeticError):
        ev._exact_interval(870_000, 1_000_000)


@pytest.mark.parametrize("c, dxy", [(0.9234872, 0.8469744), (0.9257115, 0.8514230)])
def test_dxy_golden(c, dxy):
    assert 2 * (c - 0.5) == pytest.approx(dxy, abs=1e-9)


def test_c_statistic_special_cases(spark):
    assert c_of(frame(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]))["c"] == 0.5
    assert c_of(frame(spark, [(0.9, 1), (0.1, 0)]))["c"] == 1 and c_of(frame(spark, [(0.1, 1), (0.9, 0)]))["dxy"] == -1
    one_class = c_of(frame(spark, [(0.1, 0), (0.9, 0), (None, 0), (0.3, None)]))
    assert (one_class["c"], one_class["n"], one_class["missing"]) == (None, 2, 2)


@pytest.mark.parametrize("max_window_rows", [10**6, 5])
def test_curve_equals_brute_force(spark, max_window_rows):
    rng = random.Random(3)
    data = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    curve = threshold_curve(frame(spark, data), "s", "y", max_window_rows=max_window_rows)
    got = {r["cutoff"]: r for r in curve.collect()}
    scores = sorted({s for s, _ in data}, reverse=True)
    assert sorted(got, reverse=True) == scores
    for i, c in enumerate(scores):
        r = got[c]
        assert r["tp"] == sum(y for s, y in data if s >= c) and r["fp"] == sum(1 - y for s, y in data if s >= c)
        assert r["tp"] + r["fn"] == r["n_pos"] == sum(y for _, y in data) and r["fp"] + r["tn"] == r["n_neg"]
        assert r["next_pos"] == (sum(y for s, y in data if s == scores[i + 1]) if i + 1 < len(scores) else None)
        assert r["rpp"] == (r["tp"] + r["fp"]) / 400
    pairs = [(a, b) for (a, ya), (b, yb) in itertools.product(data, data) if ya == 1 and yb == 0]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
    df = frame(spark, data)
    assert c_of(df)["c"] == pytest.approx(expected, abs=1e-12)
    vec = df.withColumn("rawPrediction", F.col("s")).withColumn("y", F.col("y").cast("double"))
    judge = BinaryClassificationEvaluator(labelCol="y", numBins=0)
    assert judge.evaluate(vec, {judge.metricName: "areaUnderROC"}) == pytest.approx(expected, abs=1e-9)
    assert judge.evaluate(vec, {judge.metricName: "areaUnderPR"}) == pytest.approx(ev.area_under_pr(curve).first()["aucpr"], abs=1e-9)


def test_curve_by_group_with_a_null_group(spark):
    df = spark.createDataFrame([(g, i / 20, i % 3 // 2) for g in ("a", "b", None) for i in range(20)], "g string, s double, y int")
    a = threshold_curve(df, "s", "y", ["g"])
    b = threshold_curve(df, "s", "y", ["g"], max_window_rows=4)
    assert rows(a.select(*sorted(a.columns)), "g", "cutoff") == rows(b.select(*sorted(a.columns)), "g", "cutoff") and a.count() == 60


def test_alert_cutoff_is_strict(spark):
    # 100 rows with distinct scores: the highest alone is exactly 1 %.
    df = frame(spark, [(i / 100, i % 2) for i in range(100)])
    curve = threshold_curve(df, "s", "y")
    got = {r["alert_rate"]: r["cutoff"] for r in ev.alert_cutoffs(curve, [0.01, 0.011, 0.03]).collect()}
    assert got == {0.01: None, 0.011: 0.99, 0.03: 0.98}
    assert ev.first_cutoff_above(curve, 0.01).first()["cutoff"] == 0.98


def test_cutoff_itself_depends_on_the_rule(spark):
    df = frame(spark, [(0.5, 1), (0.5, 0), (0.6, 1), (0.4, 0), (None, 1)])
    assert rows(ev.confusion_counts(df, "s", "y", 0.5)) == [(1, 0, 1, 2)]
    assert rows(ev.confusion_counts(df, "s", "y", 0.5, inclusive=True)) == [(2, 1, 0, 1)]
    strict, loose = ev.at_thresholds(df, "s", "y", [0.5], inclusive=False).first(), ev.at_thresholds(df, "s", "y", [0.5]).first()
    assert (strict["tp"], strict["fp"], loose["tp"], loose["fp"]) == (1, 0, 2, 1)
    none = ev.confusion_stats(ev.confusion_counts(df, "s", "y", 0.9)).first()
    assert none["ppv"] is None and none["sens"] == 0 and none["spec"] == 1


def test_two_class_summary_uses_strict_cutoff(spark):
    df = frame(spark, [(0.01, 1), (0.02, 1), (0.01, 0), (0.005, 0)])
    r = ev.two_class_summary(df, "s", "y", 0.01).first()
    assert (r["sens"], r["spec"], r["roc"]) == (0.5, 1.0, pytest.approx((0.5 + 1 + 2) / 4))


def test_best_threshold_and_weights(spark):
    df = frame(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0), (0.4, 1), (0.3, 0), (0.2, 0)])
    curve = threshold_curve(df, "s", "y")
    assert ev.best_threshold(curve).first()["cutoff"] == 0.7
    # A cheap miss and a rare class push the cutoff up.
    assert ev.best_threshold(curve, prevalence=0.01, cost=1).first()["cutoff"] == 0.9
    assert sorted(r["cutoff"] for r in ev.local_maxima(curve).collect()) == [0.4, 0.7, 0.9]
    assert ev.break_even(curve).first()["cutoff"] == 0.7


def test_calibration_parts_cover_all_rows(spark):
    df = frame(spark, [(i / 1000, int(i % 10 < i / 100)) for i in range(1000)] + [(0.5, 1)] * 200)
    parts = rows(ev.calibration(threshold_curve(df, "s", "y")), "part")
    assert sum(p[1] for p in parts) == 1200 and [p[0] for p in parts] == sorted({p[0] for p in parts})
    assert all(abs(p[2] - p[3]) == pytest.approx(p[4]) for p in parts)


def test_sweep_and_bundle(spark):
    df = frame(spark, [(0.9, 1), (0.2, 0), (0.6, 0), (0.4, 1)])
    sweep = {r["prob_threshold"]: r for r in ev.threshold_sweep(df, "s", "y", [0.0, 0.5, 1.0]).collect()}
    assert (sweep[0.0]["sens"], sweep[0.0]["spec"], sweep[0.5]["j"]) == (1, 0, 0) and sweep[1.0]["dist"] == 1
    bundle = {r["metric"]: r["value"] for r in ev.metric_bundle(df, "s", "y", [0.5]).collect()}
    assert bundle == {"f": 0.5, "auc": 0.5, "ppv": 0.5, "npv": 0.5, "sens": 0.5, "spec": 0.5, "acc": 0.5, "err": 0.5, "rpp": 0.5}


def test_missing_rows_are_counted_per_group_and_leave_the_curve_alone(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 1), ("a", 0.4, 0), ("a", None, 1), ("a", 0.3, None), ("b", 0.9, 0), ("b", 0.1, 1), ("c", None, 1)], "g string, s double, y int"
    )
    got = {r["g"]: tuple(r)[1:] for r in ev.c_statistic(df, "s", "y", ["g"]).collect()}
    assert got == {"a": (1.0, 1.0, 2, 2), "b": (0.0, -1.0, 2, 0), "c": (None, None, 0, 1)}
    for limit in (10**6, 1):
        curve = threshold_curve(df, "s", "y", ["g"], max_window_rows=limit)
        assert rows(curve.select("g", "cutoff", "tp", "fp", "next_pos"), "g", "cutoff") == [
            ("a", 0.4, 1, 1, None), ("a", 0.5, 1, 0, 0), ("b", 0.1, 1, 1, None), ("b", 0.9, 0, 1, 1),
        ]
