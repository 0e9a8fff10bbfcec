"""Isotonic scores against pooling of adjacent violators, smoothed rates against weighted least squares, and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cohortloom.operators.calibrate import isotonic_scores, smooth_rate
from cohortloom.operators.curve import threshold_curve


def pooled(rows):
    """Adjacent violators, pooled one after the other."""
    blocks = []
    for score in sorted({s for s, _ in rows}):
        some = [y for s, y in rows if s == score]
        blocks.append([[score], sum(some), len(some)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            scores, y, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + y, blocks[-1][2] + n]
    return {s: y / n for scores, y, n in blocks for s in scores}


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_isotonic_scores_equal_pooled_violators(spark, most):
    r = random.Random(7)
    rows = [(g, s, int(r.random() < s / 50)) for g, n in (("a", 300), ("b", 40), (None, 60), ("one", 1), ("flat", 20)) for s in [float(r.randrange(-5, 50)) for _ in range(n)]]
    rows = [(g, s, 1 if g == "flat" else y) for g, s, y in rows] + [("a", 20.0, 1)] * 400 + [("a", 30.0, 0)] * 400 + [("a", None, 1), ("a", 3.0, None), ("a", float("nan"), 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "g string, score double, label int, n int")
    known = [(g, s, y) for g, s, y in rows if s is not None and s == s and y is not None]
    got = isotonic_scores(threshold_curve(df.filter("score is null or not isnan(score)"), "score", "label", ["g"]), ["g"], max_window_rows=most).collect()
    for g in {g for g, *_ in known}:
        want = pooled([(s, y) for k, s, y in known if k == g])
        assert {x.cutoff: x.rate for x in got if x.g == g} == want
        assert all(x.n == sum(k == g and s == x.cutoff for k, s, _ in known) for x in got if x.g == g)
    whole = isotonic_scores(threshold_curve(df.filter("g = 'a' and not isnan(score)"), "score", "label"), max_window_rows=most).collect()
    assert {x.cutoff: x.rate for x in whole} == pooled([(s, y) for k, s, y in known if k == "a"])
    assert isotonic_scores(threshold_curve(df.limit(0), "score", "label")).count() == 0


def test_smooth_rate_is_a_weighted_line(spark):
    r = random.Random(9)
    rows = [(r.choice("ab"), float(r.randrange(0, 100)) / 4, int(r.random() < 0.3)) for _ in range(400)] + [("c", 5.0, 1), ("c", 5.0, 0), ("d", 90.5, 1), ("a", None, 1), ("a", float("nan"), 1), ("a", float("inf"), 1), ("a", 3.0, None)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "g string, x double, label int, at double")
    got = {(p.g, p.at): p for p in smooth_rate(df, "x", "label", 2.5, 6.0, ["g"]).collect()}
    want = {}
    for g in "abcd":
        some = [(x, y) for k, x, y in rows if k == g and x is not None and np.isfinite(x) and y is not None]
        for at in np.arange(-20, 120, 2.5):
            near = [(x - at, y) for x, y in some if abs(x - at) < 6]
            if near and min(near)[0] <= 0 <= max(near)[0]:
                d, y = np.array(near).T
                root = np.sqrt((1 - (abs(d) / 6) ** 3) ** 3)
                line = np.linalg.lstsq(np.stack([root, root * d], 1), root * y, rcond=None)[0][0] if len(set(d)) > 1 else y.mean()
                want[g, at] = (len(near), min(max(line, 0), 1))
    assert set(got) == set(want) and ("c", 5.0) in got and not any(g == "d" for g, _ in got)
    for key, (n, rate) in want.items():
        assert got[key].n == n and got[key].rate == pytest.approx(rate, abs=1e-7)
    # no point in reach of any value
    assert smooth_rate(df.filter("g = 'd'"), "x", "label", 50.0, 1.0).count() == 0
