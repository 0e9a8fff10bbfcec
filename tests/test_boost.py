"""Second-order trees against a plain version, growth without refitting, settings that prune, and edge cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import boost
from cohortloom.operators.boost import Fit, SecondOrder

NAMES = ["a", "b", "c"]


def rows_of(n, seed, missing=0.15):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x = [r.randrange(5), r.randrange(3), round(r.random(), 1)]
        y = float(r.random() < 1 / (1 + math.exp(-(x[0] - 2 + 2 * (x[1] == 1) - 3 * (x[2] > 0.5)))))
        out.append((k, *(None if r.random() < missing else float(v) for v in x), y))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, a double, b double, c double, label double")


def plain_trees(rows, params):
    """Exact greedy trees over all values; margins per row after each round."""
    x, y = [r[1:4] for r in rows], [r[4] for r in rows]
    margins, log = [0.0] * len(rows), []

    def strength(g, h):
        return g * g / (h + params.penalty) if h + params.penalty > 0 else 0.0

    def best(at, g, h):
        top, tg, th = None, sum(g[k] for k in at), sum(h[k] for k in at)
        for f in range(3):
            for cut in sorted({x[k][f] for k in range(len(rows)) if x[k][f] is not None})[1:]:
                for missing_left in (False, True):
                    left = [k for k in at if (missing_left if x[k][f] is None else x[k][f] < cut)]
                    right = sorted(set(at) - set(left))
                    lg, lh = sum(g[k] for k in left), sum(h[k] for k in left)
                    gain = round(strength(lg, lh) + strength(tg - lg, th - lh) - strength(tg, th), 9)
                    if left and right and min(lh, th - lh) >= params.min_child_weight and gain > 1e-9 and (top is None or gain > top[0]):
                        top = gain, left, right
        return top

    def grown(at, depth, g, h):
        """Values of the rows, and whether it is a leaf."""
        value = -params.eta * sum(g[k] for k in at) / (sum(h[k] for k in at) + params.penalty)
        found = best(at, g, h) if depth else None
        if found is None:
            return {k: value for k in at}, True
        gain, left, right = found
        (l_values, l_leaf), (r_values, r_leaf) = grown(left, depth - 1, g, h), grown(right, depth - 1, g, h)
        if l_leaf and r_leaf and gain < params.gamma:
            return {k: value for k in at}, True
        return l_values | r_values, False

    for _ in range(params.rounds):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        values, _ = grown(list(range(len(rows))), params.depth, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p])
        margins = [m + values[k] for k, m in enumerate(margins)]
        log.append(list(margins))
    return log


@pytest.mark.parametrize("more", [{}, {"gamma": 3.0}, {"min_child_weight": 6.0, "penalty": 0.5}])
def test_trees_equal_a_plain_version(spark, more):
    rows, params = rows_of(150, 3), SecondOrder(rounds=2, depth=3, eta=0.4, **more)
    fit = Fit(frame(spark, rows), NAMES, "label", "key", params).grow(2)
    got = {r.key: list(r.steps) for r in fit.rows.collect()}
    for k, want in enumerate(zip(*plain_trees(rows, params))):
        assert got[k] == pytest.approx(want, abs=1e-6)
    scored = {r.key: r.score for r in boost.score_second_order(fit.model, frame(spark, rows)).collect()}
    assert all(scored[k] == pytest.approx(1 / (1 + math.exp(-got[k][-1])), abs=1e-9) for k in got)


def shape(model):
    return [[(k, n.feature, n.bin, n.missing_left, round(n.g, 6)) for k, n in sorted(t.items())] for t in model.trees]


def splits(model):
    return sum(n.feature is not None for t in model.trees for n in t.values())


def test_gamma_and_child_weight_prune(spark):
    df = frame(spark, rows_of(150, 5))
    sizes = [splits(boost.fit_second_order(df, NAMES, "label", "key", SecondOrder(rounds=1, depth=4, **m))) for m in ({}, {"gamma": 2.0}, {"gamma": 1e6}, {"min_child_weight": 12.0}, {"min_child_weight": 1e6})]
    assert sizes[0] > sizes[1] > sizes[2] == 0 and sizes[0] > sizes[3] > sizes[4] == 0


def test_growth_goes_on_without_refitting_and_takes_one_pass_per_level(spark, monkeypatch):
    df, calls, real = frame(spark, rows_of(120, 7)), [], boost.level_sums
    monkeypatch.setattr(boost, "level_sums", lambda *a: calls.append(1) or real(*a))
    params = SecondOrder(rounds=3, depth=2)
    one = Fit(df, NAMES, "label", "key", params).grow(3)
    assert len(calls) == 6
    two = Fit(df, NAMES, "label", "key", params).grow(2).grow(1)
    assert len(calls) == 12 and shape(two.model) == shape(one.model)
    assert [r.steps[0] for r in two.rows.orderBy("key").collect()] == pytest.approx([r.steps[2] for r in one.rows.orderBy("key").collect()])


def test_rows_that_do_not_learn_change_nothing_but_get_margins(spark):
    rows = rows_of(100, 11)
    df = frame(spark, rows + [(1000 + k, 1.0, 1.0, 0.2, None if k % 2 else 1.0) for k in range(20)])
    params = SecondOrder(rounds=2, depth=2)
    some = Fit(df, NAMES, "label", "key", params, F.col("key") < 1000).grow(2)
    assert shape(some.model) == shape(Fit(frame(spark, rows), NAMES, "label", "key", params).grow(2).model)
    assert some.rows.filter("key >= 1000 and margin is not null").count() == 20


def test_draws_depend_on_key_and_seed_alone(spark):
    df, params = frame(spark, rows_of(200, 13)), SecondOrder(rounds=2, depth=2, row_share=0.5, column_share=0.67)
    a, b = (boost.fit_second_order(d, NAMES, "label", "key", params) for d in (df, df.repartition(5, "key")))
    assert shape(a) == shape(b)
    assert all(len({n.feature for n in t.values()} - {None}) <= 2 for t in a.trees)


def test_no_rows_constant_and_missing_features(spark):
    empty = boost.fit_second_order(frame(spark, []), NAMES, "label", "key", SecondOrder(rounds=1))
    assert [r.score for r in boost.score_second_order(empty, frame(spark, rows_of(2, 1))).collect()] == [0.5, 0.5]
    flat = frame(spark, [(k, 1.0, None, float("nan"), float(k % 3 == 0)) for k in range(30)])
    model = boost.fit_second_order(flat, NAMES, "label", "key", SecondOrder(rounds=1, eta=1.0, penalty=0.0))
    assert splits(model) == 0 and boost.score_second_order(model, flat).first().score == pytest.approx(1 / (1 + math.exp(2 / 3)))


def test_node_table_and_importance(spark):
    model = boost.fit_second_order(frame(spark, rows_of(150, 17)), NAMES, "label", "key", SecondOrder(rounds=2, depth=2))
    nodes = boost.node_table(spark, model)
    assert nodes.filter("feature is not null").count() == splits(model) and nodes.filter("feature is null and value is null").count() == 0
    shares = boost.importance_parts(nodes).agg(*[F.sum(c) for c in ("gain", "cover", "frequency")]).first()
    assert list(shares) == pytest.approx([1.0] * 3)


def test_patience_ends_the_growth(spark):
    df = frame(spark, rows_of(300, 19)).withColumn("fold", (F.col("key") % 2).cast("int"))
    table, best = boost.cv_second_order(df, NAMES, "label", "key", SecondOrder(rounds=60, depth=2, eta=1.5, penalty=0.0, min_child_weight=0.0), fold="fold", folds=2, patience=2, stage=4)
    assert 4 <= table.count() < 60 and 1 <= best <= table.count()


def test_a_grid_over_gamma_and_child_weight(spark):
    df = frame(spark, rows_of(200, 23)).withColumn("fold", (F.col("key") % 2).cast("int"))
    grid = boost.parameter_grid({"rounds": [1, 2], "depth": [2], "gamma": [0.0, 1e6]})
    found = {(r.rounds, r.gamma): r for r in boost.grid_second_order(df, NAMES, "label", "key", grid, fold="fold", folds=2).collect()}
    assert len(found) == 4 and found[2, 1e6].roc == 0.5 < found[2, 0.0].roc
