"""Threshold and model queries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluate as ev
from ..operators import boost
from ..operators.boost import SecondOrder
from ..operators.calibrate import isotonic_scores, smooth_rate
from ..operators.curve import threshold_curve
from ..operators.model import Boosting, best_setting, choose_rounds, fit, importance, out_of_fold, score, search_grid
from ..operators.prep import feature_pipeline
from ..operators.split import stratified_folds, stratified_split
from ..session import written_once
from .registry import query
from .star import scored, table, visits


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def curve(spark: SparkSession, sf: str, by=(), **more) -> DataFrame:
    return threshold_curve(scored(spark, sf), "score", "label", by, **more)


COUNTS = ("cutoff", "pos", "neg", "next_pos", "tp", "fp", "fn", "tn")
RATES = ("rpp", "sens", "spec", "ppv", "npv")


@query
def score_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curve(spark, sf).select(*COUNTS, *RATES), *RATES)


@query
def score_curve_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same table computed in segments of the score range."""
    return rounded(curve(spark, sf, max_window_rows=500).select(*COUNTS, *RATES), *RATES)


@query
def auc_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.c_statistic(scored(spark, sf), "score", "label", ["hour"]), "c", "dxy")


@query
def two_class_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.two_class_summary(scored(spark, sf), "score", "label", 0.5, ["hour"]), "roc", "sens", "spec")


STATS = (
    "accuracy", "no_information_rate", "kappa", "mcnemar", "sens", "spec", "ppv", "npv", "f1", "prevalence",
    "detection_rate", "detection_prevalence", "balanced_accuracy",
)


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.confusion_stats(ev.confusion_counts(scored(spark, sf), "score", "label", 0.5, ["hour"])), *STATS)


@query
def confusion_document_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("score"), F.col("toxic").alias("label"))
    return rounded(ev.confusion_stats(ev.confusion_counts(rows, "score", "label", 0.5)), *STATS)


EXACT = ("accuracy_lower", "accuracy_upper", "p_accuracy_above_nir", "p_mcnemar")


@query
def confusion_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact interval and p-values; these come from a few summary rows."""
    tests = ev.exact_tests(ev.confusion_stats(ev.confusion_counts(scored(spark, sf), "score", "label", 0.5, ["hour"])))
    return rounded(tests.select("hour", "tp", "fp", "fn", "tn", *EXACT), *EXACT, digits=6)


@query
def at_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.at_thresholds(scored(spark, sf), "score", "label", [0.1, 0.25, 0.5, 0.9])
    return rounded(rows.select("threshold", "tp", "fp", *RATES), *RATES)


@query
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.best_threshold(curve(spark, sf, ["hour"]), ["hour"]), "cutoff", "sens", "spec", "ppv", "objective")


@query
def best_threshold_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.best_threshold(curve(spark, sf), prevalence=0.2, cost=3), "cutoff", "sens", "spec", "ppv", "objective")


@query
def curve_local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.local_maxima(curve(spark, sf)).select("cutoff", "tp", "fp", "sens", "spec"), "sens", "spec")


@query
def alert_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.alert_cutoffs(curve(spark, sf, ["hour"]), [0.01, 0.02, 0.03], ["hour"]), "sens", "spec", "ppv")


@query
def first_cutoff_above(spark: SparkSession, sf: str) -> DataFrame:
    return ev.first_cutoff_above(curve(spark, sf, ["hour"]), 0.01, ["hour"])


@query
def break_even(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.break_even(curve(spark, sf)), "sens", "spec", "ppv", "gap")


@query
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.calibration(curve(spark, sf)), "mean_score", "observed", "error")


@query
def isotonic_score(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated score of every distinct score."""
    return rounded(isotonic_scores(curve(spark, sf)), "rate")


@query
def isotonic_score_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The same per hour, in segments of the score range."""
    return rounded(isotonic_scores(curve(spark, sf, ["hour"]), ["hour"], max_window_rows=500), "rate")


@query
def smoothed_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome rate over the score, smoothed, per hour."""
    return rounded(smooth_rate(scored(spark, sf), "score", "label", 0.125, 0.3125, ["hour"]), "rate")


@query
def area_under_pr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.area_under_pr(curve(spark, sf, ["hour"]), ["hour"]), "aucpr")


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.threshold_sweep(scored(spark, sf), "score", "label", [i / 20 for i in range(21)]), "sens", "spec", "j", "dist")


@query
def metric_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.metric_bundle(scored(spark, sf), "score", "label", [0.1, 0.3, 0.5]), "value")


# Model queries. Their features are flags, trees are deep enough for all of them and every row counts, so that a boosted model
# is a table with one value for each combination of flags, which SQL can compute. Deeper runs on more features are in the tests.

NUMERIC = ["ed", "ip", "long_stay"]
CATEGORIES = ["urgency"]
DEEP = {"depth": 6, "subsample": 1.0}


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per visit: three flags, a category of two levels and a label."""
    label = scored(spark, sf).select("encounter_id", F.col("label").cast("double").alias("label"))
    urgent = F.col("priority").isin("1-URGENT", "2-HIGH")
    rows = visits(spark, sf).select(
        "encounter_id", "ed", "ip", (F.col("stay") >= 7).cast("int").alias("long_stay"), F.when(urgent, "high").otherwise("low").alias("urgency")
    )
    return rows.join(label, "encounter_id")


def prepared(spark: SparkSession, sf: str):
    """Training and test rows with feature vectors. Joins and split are written once; every later pass reads that."""
    joined = written_once(model_rows(spark, sf))
    rows = written_once(stratified_split(joined, "encounter_id", "label", 124800), spread_by="encounter_id")
    train, test = rows.filter("is_train"), rows.filter("not is_train")
    stages = feature_pipeline(NUMERIC, CATEGORIES).fit(train)
    return stages.transform(train), stages.transform(test)


@query
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = prepared(spark, sf)
    model = fit(train.select("features", "label"), Boosting(rounds=3, **DEEP))
    return rounded(score(model, test).select("encounter_id", "label", "score"), "score")


@query
def gbt_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Of one cut: the feature that explains most has all the importance."""
    train, _ = prepared(spark, sf)
    found = importance(fit(train.select("features", "label"), Boosting(rounds=1, depth=1, subsample=1.0)), train)
    return found.filter("importance > 0")


def folded(spark: SparkSession, sf: str, folds: int) -> DataFrame:
    train, _ = prepared(spark, sf)
    fold = stratified_folds(train.select("encounter_id", "label"), "encounter_id", "label", 1234, folds).select("encounter_id", "fold")
    return written_once(train.select("encounter_id", "features", "label").join(fold, "encounter_id"), spread_by="encounter_id")


@query
def cv_rounds(spark: SparkSession, sf: str) -> DataFrame:
    table_, best = choose_rounds(folded(spark, sf, 2), Boosting(rounds=3, **DEEP), fold="fold", folds=2)
    table_ = table_.withColumn("chosen", F.col("round") == best)
    return rounded(table_, "train_mean", "train_sd", "test_mean", "test_sd")


@query
def cv_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the training rows by models that have not seen them."""
    return rounded(out_of_fold(folded(spark, sf, 2), Boosting(rounds=3, **DEEP), key="encounter_id", fold="fold", folds=2), "score")


def grid_results(spark: SparkSession, sf: str) -> DataFrame:
    grid = [Boosting(rounds=r, eta=e, **DEEP) for r in (1, 3) for e in (0.1, 0.3)]
    found = search_grid(folded(spark, sf, 2), grid, fold="fold", folds=2)
    return rounded(found.select("rounds", "eta", "roc", "sens", "spec", "roc_sd", "sens_sd", "spec_sd"), "roc", "sens", "spec", "roc_sd", "sens_sd", "spec_sd")


@query
def cv_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_results(spark, sf)


@query
def cv_best_setting(spark: SparkSession, sf: str) -> DataFrame:
    return best_setting(grid_results(spark, sf).withColumn("depth", F.lit(DEEP["depth"]))).drop("depth")


# Second-order trees. Without a penalty each cell of flags takes one Newton step per round, which SQL can compute.

FLAG_NAMES = ["ed", "ip", "long_stay", "urgent"]


def flag_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_rows(spark, sf).withColumn("urgent", (F.col("urgency") == "high").cast("int"))
    return stratified_split(written_once(rows), "encounter_id", "label", 124800)


CELLS = SecondOrder(rounds=3, eta=0.5, depth=5, min_child_weight=0.0, penalty=0.0)


@query
def gbt_second_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = written_once(flag_rows(spark, sf))
    model = boost.fit_second_order(rows.filter("is_train"), FLAG_NAMES, "label", "encounter_id", CELLS)
    return rounded(boost.score_second_order(model, rows.filter("not is_train")).select("encounter_id", "label", "score"), "score")


@query
def gbt_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of three trees of one split each, with a penalty on leaf values."""
    model = boost.fit_second_order(flag_rows(spark, sf).filter("is_train"), FLAG_NAMES, "label", "encounter_id", STUMPS)
    return rounded(boost.node_table(spark, model), "gain", "cover", "value", digits=6)


STUMPS = SecondOrder(rounds=3, eta=0.5, depth=1, min_child_weight=1.0, penalty=2.0)


@query
def importance_parts(spark: SparkSession, sf: str) -> DataFrame:
    model = boost.fit_second_order(flag_rows(spark, sf).filter("is_train"), FLAG_NAMES, "label", "encounter_id", STUMPS)
    found = boost.importance_parts(boost.node_table(spark, model))
    return rounded(found, "gain", "cover", "frequency", "total_gain", "total_cover", digits=6)


def flag_folds(spark: SparkSession, sf: str, folds: int) -> DataFrame:
    train = written_once(flag_rows(spark, sf).filter("is_train"))
    fold = stratified_folds(train.select("encounter_id", "label"), "encounter_id", "label", 1234, folds).select("encounter_id", "fold")
    return train.join(fold, "encounter_id")


@query
def cv_second_order(spark: SparkSession, sf: str) -> DataFrame:
    """Both folds grow two trees, then one more from where they stood."""
    table_, best = boost.cv_second_order(flag_folds(spark, sf, 2), FLAG_NAMES, "label", "encounter_id", CELLS, fold="fold", folds=2, stage=2)
    return rounded(table_.withColumn("chosen", F.col("round") == best), "train_mean", "train_sd", "test_mean", "test_sd")


@query
def grid_second_order(spark: SparkSession, sf: str) -> DataFrame:
    grid = boost.parameter_grid({"rounds": [1, 3], "eta": [0.1, 0.5], "depth": [5], "min_child_weight": [0.0], "penalty": [0.0]})
    found = boost.grid_second_order(flag_folds(spark, sf, 2), FLAG_NAMES, "label", "encounter_id", grid, fold="fold", folds=2)
    names = ["roc", "sens", "spec", "roc_sd", "sens_sd", "spec_sd"]
    return rounded(found.select("rounds", "eta", *names), *names)
