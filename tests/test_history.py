from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from cohortloom.operators.dedupe import first_row_per_key
from cohortloom.operators.history import history_features, visits_in_period

T0 = datetime(2017, 6, 1, 12)
US = timedelta(microseconds=1)
SPEC = dict(
    keys=["site", "patient"], index_id="id", index_ts="start", prior_id="id", prior_ts="end",
    since={"since_ed": "ed", "since_ip": "ip"}, ever={"any_x": "x"}, latest={"last_los": ("ip", "los")},
)
SCHEMA = "site string, patient string, id long, start timestamp, end timestamp, ed int, ip int, x int, los double"


def features(spark, visits, **more):
    df = spark.createDataFrame(visits, SCHEMA)
    return history_features(df, df, **{**SPEC, **more})


def brute(visits):
    out = {}
    for s, p, i, start, *_ in visits:
        if start is None or p is None:
            continue
        prev = [v for v in visits if v[0] == s and v[1] == p and v[4] is not None and v[4] < start]
        if not prev:
            continue
        days = lambda v: (start - v[4]) // timedelta(days=1)
        ed, ip = [v for v in prev if v[5] == 1], [v for v in prev if v[6] == 1]
        out[i] = (
            sum(days(v) <= 365 for v in prev), min(map(days, ed), default=None), min(map(days, ip), default=None),
            max(int(v[7] == 1) for v in prev), max(ip, key=lambda v: (v[4], v[2]))[8] if ip else None,
        )
    return out


def as_dict(df):
    return {r["id"]: (r["n_past_year"], r["since_ed"], r["since_ip"], r["any_x"], r["last_los"]) for r in df.collect()}


def test_edges_of_strictness(spark):
    visits = [
        ("a", "p", 1, T0, None, 0, 1, 0, 1.0),
        ("a", "p", 2, T0 - timedelta(days=9), T0, 1, 0, 0, 2.0),            # ends exactly at the start of 1: not earlier
        ("a", "p", 3, T0 - timedelta(days=9), T0 - US, 0, 1, 0, 3.0),       # a microsecond earlier counts
        ("a", "p", 4, T0 - timedelta(days=400), T0 - timedelta(days=366), 0, 0, 1, 4.0),            # 366 days: out of the year
        ("a", "p", 5, T0 - timedelta(days=400), T0 - timedelta(days=366) + US, 0, 0, 0, 5.0),       # 365 whole days: in
        ("b", "p", 6, T0, None, 0, 0, 0, None),                             # same patient number at another site
        ("a", None, 7, T0, T0 - timedelta(days=1), 1, 1, 1, 9.0),           # no patient
    ]
    got = as_dict(features(spark, visits))
    assert got[1] == (2, None, 0, 1, 3.0)
    assert 6 not in got and 7 not in got
    assert got == brute(visits)


def test_null_value_on_last_visit_stays_null_and_ties_go_to_the_higher_id(spark):
    end = T0 - timedelta(days=2)
    visits = [
        ("a", "p", 1, T0, None, 0, 0, 0, None),
        ("a", "p", 2, T0 - timedelta(days=30), T0 - timedelta(days=20), 0, 1, 0, 7.0),
        ("a", "p", 3, T0 - timedelta(days=5), end, 0, 1, 0, 8.0),
        ("a", "p", 4, T0 - timedelta(days=4), end, 0, 1, 0, None),
    ]
    assert as_dict(features(spark, visits))[1][4] is None
    visits[3] = (*visits[3][:6], 0, 0, None)
    assert as_dict(features(spark, visits))[1][4] == 8.0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_and_without_segments(spark, seed):
    rng = random.Random(seed)
    visits = []
    for i in range(400):
        patient = "hot" if rng.random() < 0.4 else f"p{rng.randrange(20)}"
        start = T0 + timedelta(hours=rng.randrange(0, 24 * 900, 12))
        end = None if rng.random() < 0.05 else start + timedelta(hours=rng.choice([0, 12, 24, 72]))
        visits.append(("a", patient, i, start, end, rng.randrange(2), rng.randrange(2), int(rng.random() < 0.1), rng.choice([None, 1.0, 2.0])))
    expected = brute(visits)
    assert as_dict(features(spark, visits)) == expected
    assert as_dict(features(spark, visits, hot_rows=25)) == expected
    df = spark.createDataFrame(visits, SCHEMA)
    assert as_dict(history_features(df.repartition(1), df.repartition(17), **SPEC)) == expected


def test_visits_in_period_keeps_only_positive_counts(spark):
    visits = [
        ("a", "p", 1, T0, T0 + timedelta(days=1), 0, 0, 0, None),
        ("a", "p", 2, T0 + timedelta(days=30), T0 + timedelta(days=31), 0, 0, 0, None),
        ("a", "p", 3, T0 + timedelta(days=900), T0 + timedelta(days=901), 0, 0, 0, None),
    ]
    df = spark.createDataFrame(visits, SCHEMA)
    got = visits_in_period(df, df, keys=["site", "patient"], index_id="id", index_ts="start", prior_id="id", prior_ts="end")
    assert rows(got) == [(2, 1)]


def test_first_row_per_key(spark):
    df = spark.createDataFrame(
        [("a", T0, 2), ("a", T0, 1), ("a", None, 0), ("b", None, 5), ("c", T0, 9)], "k string, t timestamp, n int"
    )
    assert rows(first_row_per_key(df, ["k"], ["t", "n"]), "k") == [("a", T0, 1), ("b", None, 5), ("c", T0, 9)]
