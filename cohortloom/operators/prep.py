"""Preparation that is learned on the training rows and applied to any rows.

What is learned is small: one level per column, or the levels of a category.
The number of levels is checked before they are brought to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, RFormula, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .summary import value_counts

MAX_LEVELS = 10_000
NEW_LEVEL = "new"


def nominal(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold text."""
    return [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.StringType)]


def modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column (the smallest one on a tie): column, mode. A column with no value has no row."""
    counts = value_counts(train, columns).filter(F.col("value").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return counts.groupBy("column").agg(best.alias("_best")).select("column", F.col("_best.value").alias("mode"))


def fit_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """`{column: mode}`: at most one entry per column."""
    return {r["column"]: r["mode"] for r in modes(train, nominal(train, columns)).collect()}


def impute_modes(df: DataFrame, learned: Mapping[str, str]) -> DataFrame:
    return df.fillna(dict(learned)) if learned else df


def fit_levels(train: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels of each column. Raises if a column has more than `max_levels`."""
    found = value_counts(train, columns).filter(F.col("value").isNotNull())
    rows = found.select("column", "value").limit(max_levels * len(columns) + 1).collect()
    levels = {c: [] for c in columns}
    for r in rows:
        levels[r["column"]].append(r["value"])
    wide = [c for c, v in levels.items() if len(v) > max_levels]
    if wide or len(rows) > max_levels * len(columns):
        raise ValueError(f"too many levels for indicator columns: {wide or list(columns)}")
    return {c: sorted(v) for c, v in levels.items()}


def bucket_new_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], new: str = NEW_LEVEL) -> DataFrame:
    """Levels not seen in training become `new`; missing stays missing."""
    return df.withColumns({c: F.when(F.col(c).isin(list(v)) | F.col(c).isNull(), F.col(c)).otherwise(F.lit(new)) for c, v in levels.items()})


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]], new: str = NEW_LEVEL, drop_first: bool = True) -> DataFrame:
    """0/1 column per level and one for unseen levels; the first level is the reference. Missing gives nulls."""
    out = {}
    for c, seen in levels.items():
        for level in list(seen)[1 if drop_first else 0 :]:
            out[f"{c}_{level}"] = (F.col(c) == level).cast("int")
        out[f"{c}_{new}"] = (~F.col(c).isin(list(seen))).cast("int")
    return df.withColumns(out).drop(*levels)


def fit_common_levels(train: DataFrame, column: str, share: float) -> list[str]:
    """Levels that hold at least `share` of the rows with a value; there are at most 1/share of them."""
    counts = value_counts(train, [column]).filter(F.col("value").isNotNull())
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    return sorted(r["value"] for r in counts.filter(F.col("n") >= F.lit(share) * F.lit(total)).collect())


def pool_rare(df: DataFrame, column: str, common: Sequence[str], other: str = "other") -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(c.isin(list(common)) | c.isNull(), c).otherwise(F.lit(other)))


def schema_report(train: DataFrame, new: DataFrame) -> DataFrame:
    """One row per column of either frame: is it in both, same type, same place."""
    a, b = {f.name: f for f in train.schema.fields}, {f.name: f for f in new.schema.fields}
    rows = [
        (
            name, name in a, name in b,
            name in a and name in b and a[name].dataType == b[name].dataType,
            name in a and name in b and train.columns.index(name) == new.columns.index(name),
        )
        for name in dict.fromkeys([*train.columns, *new.columns])
    ]
    return train.sparkSession.createDataFrame(rows, "column string, in_train boolean, in_new boolean, same_type boolean, same_place boolean")


def ordered_like(df: DataFrame, template: DataFrame) -> DataFrame:
    """The template's columns in its order."""
    return df.select(*template.columns)


def check_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Raise if a column is absent."""
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def check_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job on the first null, while the rows stream through."""
    guard = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing value in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return df.withColumns(guard)


def binary_label(col: Column) -> Column:
    """yes/no from 0/1."""
    return F.when(col == 1, "yes").otherwise("no")


def feature_stages(numeric: Sequence[str], categories: Sequence[str], out: str = "features") -> list:
    """Index, one-hot and assemble. Each category has a slot per level and one for unseen or missing levels.

    Trees need no reference level, so none is dropped.
    """
    stages, coded = [], [f"{c}_is" for c in categories]
    if categories:
        indexed = [f"_{c}_index" for c in categories]
        stages.append(StringIndexer(inputCols=list(categories), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=False))
    stages.append(VectorAssembler(inputCols=[*numeric, *coded], outputCol=out, handleInvalid="error"))
    return stages


def formula(outcome: str, features: Sequence[str]) -> RFormula:
    """`outcome ~ a + b + ...` as an estimator; unseen levels get a bucket of their own."""
    return RFormula(formula=f"{outcome} ~ {' + '.join(features)}", handleInvalid="keep")


def feature_pipeline(numeric: Sequence[str], categories: Sequence[str], out: str = "features") -> Pipeline:
    return Pipeline(stages=feature_stages(numeric, categories, out))
