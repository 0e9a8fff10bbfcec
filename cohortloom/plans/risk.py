"""Train on one random hour per encounter, score every hour, report at alert rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import fill_not_measured
from ..operators.curve import threshold_curve
from ..operators.evaluate import alert_cutoffs, c_statistic
from ..operators.model import Boosting, choose_rounds, fit, importance, score
from ..operators.panel import one_row_per_entity
from ..operators.prep import feature_pipeline, fit_modes, impute_modes, nominal
from ..operators.split import stratified_folds, stratified_split, test_rows, train_rows
from ..session import written_once


@dataclass(frozen=True)
class RiskOptions:
    key: str = "encounter_id"
    hour: str = "hour"
    outcome: str = "outcome"
    split_hour: int = 1
    share: float = 0.7
    seed: int = 124800
    folds: int = 5
    params: Boosting = Boosting()
    alert_rates: Sequence[float] = (0.01, 0.02, 0.03)


@dataclass(frozen=True)
class RiskReport:
    features: PipelineModel
    model: GBTClassificationModel
    rounds: int
    round_table: DataFrame
    predictions: DataFrame
    by_hour: DataFrame
    alerts: DataFrame
    importance: DataFrame


def merge_panel(main: DataFrame, panel: DataFrame, main_features: Sequence[str], o: RiskOptions) -> DataFrame:
    """Rows that are in both tables, with the outcome; unlabelled rows are left out."""
    left = main.select(o.key, o.outcome, *main_features).filter(F.col(o.outcome).isNotNull())
    extra = [c for c in panel.columns if c == o.key or c not in left.columns]
    return left.join(panel.select(*extra), o.key)


def train_and_evaluate(rows: DataFrame, features: Sequence[str], o: RiskOptions = RiskOptions()) -> RiskReport:
    """`rows`: one row per (key, hour) with features and a 0/1 outcome. They are computed once; a missing number is filled as not measured."""
    categories = nominal(rows, features)
    numeric = [o.hour, *[c for c in features if c not in categories]]
    rows = written_once(fill_not_measured(rows.select(o.key, o.outcome, *dict.fromkeys([o.hour, *features])), numeric))
    entities = rows.filter(F.col(o.hour) == o.split_hour).select(o.key, o.outcome)
    split = stratified_split(entities, o.key, o.outcome, o.seed, o.share)
    split = written_once(split.select(o.key, "is_train"))
    train = written_once(train_rows(one_row_per_entity(rows, [o.key], o.hour, o.seed), split, o.key), spread_by=o.key)
    test = test_rows(rows, split, o.key)

    learned = fit_modes(train, categories)
    stages = feature_pipeline(numeric, categories).fit(impute_modes(train, learned))

    def vectors(df: DataFrame) -> DataFrame:
        out = stages.transform(impute_modes(df, learned))
        return out.select(o.key, o.hour, F.col(o.outcome).cast("double").alias("label"), "features")

    prepared = vectors(train)
    fold = stratified_folds(prepared.select(o.key, "label"), o.key, "label", o.seed, o.folds).select(o.key, "fold")
    folded = written_once(prepared.join(fold, o.key), spread_by=o.key)
    table, rounds = choose_rounds(folded, o.params, fold="fold", folds=o.folds)
    chosen = Boosting(**{**o.params.__dict__, "rounds": rounds})
    model = fit(prepared.select("features", "label"), chosen)
    scored = score(model, vectors(test), "pred").select(o.key, o.hour, "pred", F.col("label").cast("int").alias("outcome"))
    scored = written_once(scored)
    curve = threshold_curve(scored, "pred", "outcome", [o.hour])
    return RiskReport(
        stages, model, rounds, table, scored, c_statistic(scored, "pred", "outcome", [o.hour]),
        alert_cutoffs(curve, o.alert_rates, [o.hour]), importance(model, prepared),
    )
