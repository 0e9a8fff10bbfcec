"""Second-order boosted trees from histograms, with the settings a grid search wants: minimum loss reduction (`gamma`), minimum
child weight, penalty on leaf values, share of rows and of columns per tree.

Features are cut into bins once and stored. A tree grows level by level: one aggregation of gradient and hessian sums by (node,
feature, bin) over all rows, from whose small result each node's best split follows; leaf values come from the same sums, so a
tree of depth d takes d jobs and no other pass. Margins stay a column of the stored rows: a fit that goes on starts where it
stood. Rows are never repeated on the driver; it holds the trees, at most 2 ** depth splits each.

Missing values go, at each split, to the side that gains more.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import written_once
from .evaluate import c_statistic, two_class_summary
from .model import _best_round

LEAST_GAIN = 1e-9
#: Trees grown between two writes of the rows; the plan holds no more than these.
STEP = 5
NODES = "tree int, node long, feature string, cut double, missing_left boolean, gain double, cover double, value double"


@dataclass(frozen=True)
class SecondOrder:
    """Settings of one model. `column_share` is drawn per tree, `row_share` per row and tree."""

    rounds: int = 100
    eta: float = 0.3
    depth: int = 6
    gamma: float = 0.0
    min_child_weight: float = 1.0
    column_share: float = 1.0
    row_share: float = 1.0
    penalty: float = 1.0
    bins: int = 64
    seed: int = 1234


@dataclass
class Node:
    """A split (feature, bin, missing_left, gain) or, without a feature, a leaf; children of node k are 2k + 1 and 2k + 2."""

    g: float
    h: float
    feature: int | None = None
    bin: int = 0
    missing_left: bool = False
    gain: float = 0.0


Tree = dict[int, Node]


@dataclass
class Ensemble:
    features: list[str]
    cuts: list[list[float]]
    params: SecondOrder
    trees: list[Tree] = field(default_factory=list)

    def value(self, node: Node) -> float:
        weight = node.h + self.params.penalty
        return -self.params.eta * node.g / weight if weight > 0 else 0.0


def parameter_grid(options: Mapping[str, Sequence]) -> list[SecondOrder]:
    """Every combination of the listed values."""
    return [SecondOrder(**dict(zip(options, values))) for values in itertools.product(*options.values())]


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature the values at which bins begin, at most `bins` - 1: its quantiles, the least value left out. One pass for all."""
    shares = [k / bins for k in range(bins + 1)]
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    row = df.agg(*[F.percentile_approx(known[c], shares, 100 * bins).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [[float(x) for x in sorted(set(q or []))[1:] if math.isfinite(x)] for q in row]


def binned(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], out: str = "bins") -> DataFrame:
    """Adds an array with, per feature, the number of its cuts that are at or below the value; null where the value is missing."""
    work, columns = df, []
    for k, (name, own) in enumerate(zip(features, cuts)):
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
        if own:
            split = Bucketizer(splits=[-math.inf, *own, math.inf], inputCol=f"_x{k}", outputCol=f"_b{k}", handleInvalid="keep")
            work = split.transform(work.withColumn(f"_x{k}", value))
            columns.append(F.when(F.col(f"_x{k}").isNotNull(), F.col(f"_b{k}").cast("short")))
        else:
            columns.append(F.when(value.isNotNull(), F.lit(0).cast("short")))
    return work.withColumn(out, F.array(*columns).cast("array<short>")).select(*df.columns, out)


def _branch(tree: Tree, at: int, goes_left, leaf) -> Column:
    """A nested choice that ends in `leaf(node number, node)`."""
    node = tree[at]
    if node.feature is None:
        return leaf(at, node)
    return F.when(goes_left(node), _branch(tree, 2 * at + 1, goes_left, leaf)).otherwise(_branch(tree, 2 * at + 2, goes_left, leaf))


def _by_bin(node: Node) -> Column:
    return F.coalesce(F.col("bins")[node.feature] <= node.bin, F.lit(node.missing_left))


def level_sums(rows: DataFrame, columns: Sequence[int]) -> DataFrame:
    """node, feature, bin (null: missing) with the sums of g and h and the number of rows. Combined before the shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col("bins")[k].alias("bin")) for k in columns]))
    return rows.select("node", "g", "h", each.alias("_e")).groupBy("node", "_e.feature", "_e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def best_splits(sums: DataFrame, penalty: float, min_child_weight: float) -> DataFrame:
    """Per node: its own sums (g, h) and the best allowed split, if any: feature, bin (the last one that goes left), missing_left, gain,
    and the sums of its left side. Equal gains: the lowest feature, then bin, then missing to the right."""
    of_feature = Window.partitionBy("node", "feature")
    to_here = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("bin").isNotNull()
    sides = sums
    for c in ("g", "h", "n"):
        missing = F.coalesce(F.sum(F.when(~known, F.col(c))).over(of_feature), F.lit(0))
        sides = sides.withColumns({f"m{c}": missing, f"t{c}": F.sum(c).over(of_feature), f"k{c}": F.sum(F.when(known, F.col(c))).over(to_here)})
    sent = F.explode(F.array(F.lit(False), F.lit(True)))
    sides = sides.select("node", "feature", "bin", *[f"{s}{c}" for s in "mtk" for c in "ghn"], sent.alias("missing_left"))
    left = {c: F.col(f"k{c}") + F.when(F.col("missing_left"), F.col(f"m{c}")).otherwise(0) for c in "ghn"}
    right = {c: F.col(f"t{c}") - left[c] for c in "ghn"}

    def strength(g: Column, h: Column) -> Column:
        return F.when(h + penalty > 0, g * g / (h + penalty)).otherwise(0.0)

    exact = strength(left["g"], left["h"]) + strength(right["g"], right["h"]) - strength(F.col("tg"), F.col("th"))
    gain = F.round(exact, 9)  # sums in another order must not change the choice
    allowed = known & (left["n"] > 0) & (right["n"] > 0) & (left["h"] >= min_child_weight) & (right["h"] >= min_child_weight) & (gain > LEAST_GAIN)
    choice = F.struct((-gain).alias("loss"), "feature", "bin", "missing_left", left["g"].alias("left_g"), left["h"].alias("left_h"), exact.alias("gain"))
    return sides.groupBy("node").agg(F.max_by("tg", F.col("feature")).alias("g"), F.max_by("th", F.col("feature")).alias("h"), F.min(F.when(allowed, choice)).alias("best"))


class Fit:
    """A model that can go on growing. `rows` has what was passed plus margin and, after `grow`, steps: the margins after each new tree."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, key: str, params: SecondOrder, learn: Column | None = None):
        """`learn` says which rows the trees learn from (all, if not given); every row gets margins. `key` decides row draws."""
        cuts = bin_cuts(df if learn is None else df.filter(learn), features, params.bins)
        self.model, self.label = Ensemble(list(features), cuts, params), label
        used = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
        rows = binned(df, features, cuts).withColumns({"_learn": used & F.col(label).isNotNull(), "_draw": F.xxhash64(F.col(key)), "margin": F.lit(0.0), "steps": F.array().cast("array<double>")})
        self.rows = written_once(rows)

    def grow(self, trees: int) -> Fit:
        """So many more trees, the rows written every STEP of them; `steps` holds the margins of all of them."""
        self.rows = self.rows.withColumn("steps", F.array().cast("array<double>"))
        for start in range(0, trees, STEP):
            work = self.rows
            for _ in range(min(STEP, trees - start)):
                tree = self._tree(work)
                self.model.trees.append(tree)
                added = _branch(tree, 0, _by_bin, lambda _, node: F.lit(self.model.value(node)))
                work = work.withColumn("margin", F.col("margin") + added).withColumn("steps", F.concat("steps", F.array("margin")))
            self.rows = written_once(work)
        return self

    def _tree(self, work: DataFrame) -> Tree:
        p, number = self.model.params, len(self.model.trees)
        chance = 1 / (1 + F.exp(-F.col("margin")))
        drawn = F.col("_learn")
        if p.row_share < 1:
            drawn = drawn & (F.pmod(F.xxhash64("_draw", F.lit(p.seed), F.lit(number)), F.lit(1_000_000)) < int(p.row_share * 1_000_000))
        rows = work.filter(drawn).select("bins", chance.alias("_p"), (chance - F.col(self.label)).alias("g")).withColumn("h", F.col("_p") * (1 - F.col("_p")))
        names = range(len(self.model.features))
        columns = sorted(random.Random(f"{p.seed} {number}").sample(names, max(1, round(p.column_share * len(names)))))
        tree: Tree = {}
        for level in range(p.depth):
            if level and not any(k >= 2**level - 1 for k in tree):
                break
            here = _branch(tree, 0, _by_bin, lambda at, _: F.lit(at if at >= 2**level - 1 else None).cast("long")) if tree else F.lit(0).cast("long")
            found = best_splits(level_sums(rows.withColumn("node", here).filter("node is not null"), columns), p.penalty, p.min_child_weight)
            for r in found.collect():  # one row per node of the level
                node = tree[r["node"]] = Node(r["g"], r["h"])
                best = r["best"]
                if best is not None:
                    node.feature, node.bin, node.missing_left, node.gain = best["feature"], best["bin"], best["missing_left"], best["gain"]
                    tree[2 * r["node"] + 1] = Node(best["left_g"], best["left_h"])
                    tree[2 * r["node"] + 2] = Node(node.g - best["left_g"], node.h - best["left_h"])
        if not tree:
            tree[0] = Node(0.0, 0.0)
        _prune(tree, 0, p.gamma)
        return tree


def _prune(tree: Tree, at: int, gamma: float) -> None:
    """From the leaves up, splits between two leaves that gain less than `gamma` go."""
    node = tree[at]
    if node.feature is None:
        return
    sides = 2 * at + 1, 2 * at + 2
    for k in sides:
        _prune(tree, k, gamma)
    if all(tree[k].feature is None for k in sides) and node.gain < gamma:
        node.feature = None
        for k in sides:
            del tree[k]


def fit_second_order(df: DataFrame, features: Sequence[str], label: str, key: str, params: SecondOrder) -> Ensemble:
    """Fit all rounds on the rows with a label."""
    return Fit(df, features, label, key, params).grow(params.rounds).model


def score_second_order(model: Ensemble, df: DataFrame, out: str = "score", rounds: int | None = None) -> DataFrame:
    """Adds the probability of the positive class after `rounds` trees (all, if not given), as one projection of built-in expressions."""

    def goes_left(node: Node) -> Column:
        value = F.col(model.features[node.feature]).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value) < model.cuts[node.feature][node.bin], F.lit(node.missing_left))

    values = [_branch(t, 0, goes_left, lambda _, node: F.lit(model.value(node))) for t in model.trees[:rounds]]
    margin = F.aggregate(F.array(*values), F.lit(0.0), lambda a, b: a + b) if values else F.lit(0.0)
    return df.withColumn(out, 1 / (1 + F.exp(-margin)))


def node_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """One row per node: splits have feature, cut (below it goes left), missing_left and gain, leaves a value; cover is the sum of hessians."""
    rows = [
        (t, k, None if n.feature is None else model.features[n.feature], None if n.feature is None else model.cuts[n.feature][n.bin],
         None if n.feature is None else n.missing_left, None if n.feature is None else float(n.gain), float(n.h), model.value(n) if n.feature is None else None)
        for t, tree in enumerate(model.trees) for k, n in sorted(tree.items())
    ]
    return spark.createDataFrame(rows, NODES)


def importance_parts(nodes: DataFrame) -> DataFrame:
    """Per feature that some split uses: its shares of all gain, cover and splits, and the sums behind them."""
    found = nodes.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover"), F.count(F.lit(1)).alias("splits"))
    everything = Window.partitionBy(F.lit(0))  # one row per feature
    shares = {"gain": "total_gain", "cover": "total_cover", "frequency": "splits"}
    return found.withColumns({n: F.col(c) / F.sum(c).over(everything) for n, c in shares.items()})


def cv_second_order(
    df: DataFrame, features: Sequence[str], label: str, key: str, params: SecondOrder, *, fold: str, folds: int, patience: int = 20, stage: int = 10, parallelism: int = 2
) -> tuple[DataFrame, int]:
    """Cross-validated area per round (mean and standard deviation over folds, on learning and held-out rows) and the round to use.

    All folds grow `stage` trees at a time, from where they stood, until the held-out mean has not risen for `patience` rounds.
    """
    rows = written_once(df.select(key, label, fold, *features))

    def grown(fit: Fit, trees: int) -> list[tuple]:
        done = len(fit.model.trees)
        fit.grow(trees)
        long = fit.rows.select(label, F.when(F.col("_learn"), "train").otherwise("test").alias("part"), F.posexplode("steps").alias("_i", "score"))
        return [(r["part"], done + r["_i"] + 1, r["c"]) for r in c_statistic(long, "score", label, ["part", "_i"]).collect()]

    log: list[tuple] = []
    with ThreadPoolExecutor(parallelism) as pool:
        fits = list(pool.map(lambda k: Fit(rows, features, label, key, params, F.col(fold) != k), range(folds)))
        done, stopped, best = 0, False, 1
        while done < params.rounds and not stopped:
            trees = min(stage, params.rounds - done)
            log += [(k, *r) for k, found in enumerate(pool.map(lambda f: grown(f, trees), fits)) for r in found]
            done += trees
            best, stopped = _best_round(log, patience)
    table = df.sparkSession.createDataFrame(log, "fold int, part string, round int, c double")
    parts = [f(F.when(F.col("part") == p, F.col("c"))).alias(f"{p}_{n}") for p in ("train", "test") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return table.groupBy("round").agg(*parts).orderBy("round"), best


def grid_second_order(
    df: DataFrame, features: Sequence[str], label: str, key: str, grid: Sequence[SecondOrder], *, fold: str, folds: int, cutoff: float = 0.5, parallelism: int = 2
) -> DataFrame:
    """One row per setting: mean and standard deviation over the folds of roc, sens and spec on held-out rows. Settings that differ only in
    the number of rounds share a fit, which goes on from the smaller number to the larger."""
    rows = written_once(df.select(key, label, fold, *features))
    families: dict[SecondOrder, list[int]] = {}
    for p in grid:
        families.setdefault(replace(p, rounds=0), []).append(p.rounds)

    def one(job: tuple[SecondOrder, int]) -> list[tuple]:
        family, k = job
        fit, log = Fit(rows, features, label, key, family, F.col(fold) != k), []
        for n in sorted(set(families[family])):
            fit.grow(n - len(fit.model.trees))
            held_out = fit.rows.filter(~F.col("_learn")).select(label, (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
            r = two_class_summary(held_out, "score", label, cutoff).first()
            log.append((*asdict(replace(family, rounds=n)).values(), k, r["roc"], r["sens"], r["spec"]))
        return log

    with ThreadPoolExecutor(parallelism) as pool:
        log = [r for part in pool.map(one, itertools.product(families, range(folds))) for r in part]
    names = {n: "int" if t == "int" else "double" for n, t in SecondOrder.__annotations__.items()}
    kinds = [*names.values(), "int", "double", "double", "double"]
    values = [tuple(float(v) if t == "double" and v is not None else v for v, t in zip(r, kinds)) for r in log]
    long = df.sparkSession.createDataFrame(values, ", ".join(f"{n} {t}" for n, t in zip([*names, "fold", "roc", "sens", "spec"], kinds)))
    return long.groupBy(*names).agg(*[F.avg(m).alias(m) for m in ("roc", "sens", "spec")], *[F.stddev_samp(m).alias(f"{m}_sd") for m in ("roc", "sens", "spec")])
