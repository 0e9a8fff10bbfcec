"""Boosted trees: fit, choose the number of rounds, search a grid, score, explain."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir, written_once
from .evaluate import c_statistic, two_class_summary

TREES_PER_STEP = 50
FIRST_STAGE = 30


@dataclass(frozen=True)
class Boosting:
    """Settings of one boosted model."""

    rounds: int = 100
    eta: float = 0.1
    depth: int = 4
    subsample: float = 0.5
    column_share: float = 1.0
    min_child_rows: int = 1
    min_info_gain: float = 0.0
    seed: int = 1234

    def estimator(self, features: str, label: str, validation: str | None = None) -> GBTClassifier:
        booster = GBTClassifier(
            featuresCol=features, labelCol=label, maxIter=self.rounds, stepSize=self.eta, maxDepth=self.depth,
            subsamplingRate=self.subsample, featureSubsetStrategy=str(self.column_share) if self.column_share < 1 else "all",
            minInstancesPerNode=max(1, self.min_child_rows), minInfoGain=self.min_info_gain, seed=self.seed, cacheNodeIds=True, checkpointInterval=10,
        )
        return booster if validation is None else booster.setValidationIndicatorCol(validation)


def parameter_grid(options: Mapping[str, Sequence]) -> list[Boosting]:
    """Every combination of the listed values."""
    names = list(options)
    return [Boosting(**dict(zip(names, values))) for values in itertools.product(*options.values())]


def grid_frame(spark, options: Mapping[str, Sequence]) -> DataFrame:
    """The same combinations as rows."""
    rows = [tuple(v) for v in itertools.product(*options.values())]
    return spark.createDataFrame(rows, list(options))


def fit(train: DataFrame, params: Boosting, *, features: str = "features", label: str = "label", validation: str | None = None) -> GBTClassificationModel:
    """Fit on a column of feature vectors. With a boolean `validation` column boosting stops early on those rows.

    The rows are read several times, so they are kept while the model is fitted.
    """
    ensure_checkpoint_dir(train.sparkSession)
    rows = train.select(features, label, *([validation] if validation else []))
    if train.storageLevel.useMemory or train.storageLevel.useDisk:
        return params.estimator(features, label, validation).fit(rows)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return params.estimator(features, label, validation).fit(rows)
    finally:
        rows.unpersist()


def score(model, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of the positive class; a column of that name is replaced."""
    keep = [c for c in df.columns if c != out]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def staged_scores(model: GBTClassificationModel, df: DataFrame, rounds: Sequence[int] | None = None, out: str = "scores") -> DataFrame:
    """Add the probabilities after each of `rounds` trees as an array: one model gives every smaller one."""
    keep = df.columns
    for work, _ in _steps(model, df.withColumn("_scores", F.array().cast("array<double>")), sorted(set(rounds or range(1, len(model.trees) + 1)))):
        pass
    return work.select(*keep, F.concat("_scores", "_step").alias(out))


def _steps(model: GBTClassificationModel, df: DataFrame, rounds: Sequence[int]) -> Iterator[tuple[DataFrame, list[int]]]:
    """TREES_PER_STEP trees at a time: the rows with `_step`, the probabilities after those of `rounds` in this step, and which
    these are; a column `_scores` collects them. The running sum is written between steps, so that the plan stays short."""
    keep, features = df.columns, model.getFeaturesCol()
    both = list(zip(model.trees, model.treeWeights))[: max(rounds)]
    work = df.withColumn("_margin", F.lit(0.0))
    for start in range(0, len(both), TREES_PER_STEP):
        if start:
            if "_scores" in keep:
                work = work.withColumn("_scores", F.concat("_scores", "_step"))
            work = written_once(work.drop("_step"))
        step = both[start : start + TREES_PER_STEP]
        for i, (tree, _) in enumerate(step):
            work = tree.setFeaturesCol(features).setPredictionCol(f"_tree{i}").transform(work)
        margin, margins, here = F.col("_margin"), [], []
        for i, (_, weight) in enumerate(step):
            margin = margin + F.lit(float(weight)) * F.col(f"_tree{i}")
            if start + i + 1 in rounds:
                margins.append(1 / (1 + F.exp(-2 * margin)))
                here.append(start + i + 1)
        work = work.select(*keep, F.array(*margins).cast("array<double>").alias("_step"), margin.alias("_margin"))
        yield work, here


def round_metrics(model: GBTClassificationModel, df: DataFrame, label: str, rounds: Sequence[int] | None = None) -> list[tuple]:
    """(round, c) on the given rows. Rows are unfolded for the rounds of one step only, and counted per score before any shuffle."""
    out = []
    for step, here in _steps(model, df, sorted(set(rounds or range(1, len(model.trees) + 1)))):
        if here:
            long = step.select(label, F.posexplode("_step").alias("_i", "score"))
            out += [(here[r["_i"]], r["c"]) for r in c_statistic(long, "score", label, ["_i"]).collect()]
    return out


def choose_rounds(
    df: DataFrame,
    params: Boosting,
    *,
    fold: str,
    folds: int,
    features: str = "features",
    label: str = "label",
    patience: int = 20,
    rounds: Sequence[int] | None = None,
    with_train: bool = True,
    parallelism: int = 2,
) -> tuple[DataFrame, int]:
    """Cross-validated area per round and the round to use.

    The table has one row per round: mean and standard deviation over the folds on
    training (if asked for) and held-out rows. The best round is the first with the highest held-out
    mean before `patience` rounds in a row bring no gain. Models grow in stages, each twice as
    long as the one before, and no further than that: at most twice the trees that were needed.
    """
    wanted = sorted(set(rounds or range(1, params.rounds + 1)))
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(features, label, fold).persist()

    def one(k: int, grown: int, new: list[int]) -> list[tuple]:
        train, held_out = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
        model = fit(train, replace(params, rounds=grown), features=features, label=label)
        parts = [("train", train)] * with_train + [("test", held_out)]
        return [(k, name, r, c) for name, part in parts for r, c in round_metrics(model, part, label, new)]

    log: list[tuple] = []
    size = FIRST_STAGE + patience
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            done = 0
            while True:
                new = [r for r in wanted if done < r <= size]
                if new:
                    log += [r for part in pool.map(lambda k: one(k, max(new), new), range(folds)) for r in part]
                done, size = size, 2 * size
                best, waited = _best_round(log, patience)
                if waited or done >= wanted[-1]:
                    break
    finally:
        rows.unpersist()
    # folds x parts x rounds rows
    table = (
        df.sparkSession.createDataFrame(log, "fold int, part string, round int, c double")
        .groupBy("round")
        .agg(*[f(F.when(F.col("part") == p, F.col("c"))).alias(f"{p}_{n}") for p in ("train", "test") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
        .orderBy("round")
    )
    return table, best


def _best_round(log: Sequence[tuple], patience: int) -> tuple[int, bool]:
    """The first round with the highest held-out mean before the patience ran out, and whether it did."""
    by: dict[int, list[float]] = {}
    for _, part, r, c in log:
        if part == "test":
            by.setdefault(r, []).append(c)
    best_round, best, waited = min(by), float("-inf"), 0
    for r in sorted(by):
        known = [c for c in by[r] if c is not None]
        mean = sum(known) / len(known) if known else None
        if mean is not None and mean > best:
            best_round, best, waited = r, mean, 0
        else:
            waited += 1
            if waited >= patience:
                return best_round, True
    return best_round, False


def out_of_fold(df: DataFrame, params: Boosting, *, key: str, fold: str, folds: int, features: str = "features", label: str = "label", out: str = "score") -> DataFrame:
    """key, fold, label and the score of each row by the model of the other folds: for thresholds and calibration without test rows."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(key, features, label, fold).persist()
    try:
        parts = []
        for k in range(folds):
            model = fit(rows.filter(F.col(fold) != k).select(features, label), params, features=features, label=label)
            parts.append(written_once(score(model, rows.filter(F.col(fold) == k), out).select(key, fold, label, out)))
    finally:
        rows.unpersist()
    return reduce(DataFrame.unionByName, parts)


def search_grid(
    df: DataFrame,
    grid: Sequence[Boosting],
    *,
    fold: str,
    folds: int,
    features: str = "features",
    label: str = "label",
    cutoff: float = 0.5,
    parallelism: int = 2,
) -> DataFrame:
    """One row per setting: mean and standard deviation over the folds of roc, sens and spec.

    Settings that differ only in the number of rounds share one fit per fold.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(features, label, fold).persist()
    families: dict[tuple, list[Boosting]] = {}
    for p in grid:
        families.setdefault(tuple(v for k, v in asdict(p).items() if k != "rounds"), []).append(p)

    def one(job) -> list[tuple]:
        family, k = job
        rounds = sorted({p.rounds for p in family})
        biggest = max(family, key=lambda p: p.rounds)
        model = fit(rows.filter(F.col(fold) != k), biggest, features=features, label=label)
        staged = staged_scores(model, rows.filter(F.col(fold) == k), rounds).select(label, F.posexplode("scores").alias("_i", "score"))
        result = {r["_i"]: r for r in two_class_summary(staged, "score", label, cutoff, ["_i"]).collect()}
        return [(*_values(p), k, *(result[rounds.index(p.rounds)][m] for m in ("roc", "sens", "spec"))) for p in family]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            log = [r for part in pool.map(one, itertools.product(families.values(), range(folds))) for r in part]
    finally:
        rows.unpersist()
    names = list(asdict(grid[0]))
    types = "rounds int, eta double, depth int, subsample double, column_share double, min_child_rows int, min_info_gain double, seed int"
    long = df.sparkSession.createDataFrame(log, f"{types}, fold int, roc double, sens double, spec double")
    return long.groupBy(*names).agg(
        *[F.avg(m).alias(m) for m in ("roc", "sens", "spec")], *[F.stddev_samp(m).alias(f"{m}_sd") for m in ("roc", "sens", "spec")]
    )


def _values(p: Boosting) -> tuple:
    d = asdict(p)
    return tuple(float(v) if k in ("eta", "subsample", "column_share", "min_info_gain") else int(v) for k, v in d.items())


def best_setting(results: DataFrame) -> DataFrame:
    """The row with the highest roc; fewer rounds, then smaller trees on a tie."""
    return results.orderBy(F.desc("roc"), "rounds", "depth", "eta").limit(1)


def importance(model: GBTClassificationModel, prepared: DataFrame, top: int | None = None) -> DataFrame:
    """feature, importance, scaled (0 to 100), rank; one row per feature of the vector column."""
    attrs = prepared.schema[model.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    values = model.featureImportances.toArray()
    high = max(values) if len(values) and max(values) > 0 else 1.0
    order = sorted(range(len(values)), key=lambda i: (-values[i], names.get(i, str(i))))
    rows = [(names.get(i, str(i)), float(values[i]), float(100 * values[i] / high), n + 1) for n, i in enumerate(order)]
    table = prepared.sparkSession.createDataFrame(rows, "feature string, importance double, scaled double, rank int")
    return table if top is None else table.filter(F.col("rank") <= top)


def save(model: PipelineModel | GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
