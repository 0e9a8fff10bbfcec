"""Summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import normal_bounds


def rate_by(df: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    """Rows, rate of outcome = 1 and its 95 % normal interval per group."""
    rates = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(outcome) == 1, 1.0).when(F.col(outcome).isNotNull(), 0.0)).alias("rate")
    )
    low, high = normal_bounds(F.col("rate"), F.col("n"))
    return rates.withColumns({"lower": low, "upper": high})


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n in long form: one shuffle for all columns, combined before it."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_c"))
    return long.select("_c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows with a value, missing rows, distinct values."""
    counts = value_counts(df, columns)
    known = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(known).alias("distinct"),
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column and value: rows and share of the rows that have a value."""
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    # One row per listed column, so the broadcast cannot grow with the data.
    return counts.join(F.broadcast(totals), "column").select("column", "value", "n", (F.col("n") / F.col("_total")).alias("proportion"))


def any_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does the column have a null."""
    return df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in columns])


def group_totals(df: DataFrame, by: Sequence[Column], amount: Column, out: str) -> DataFrame:
    """Sum per group, biggest first."""
    return df.groupBy(*by).agg(F.sum(amount).alias(out)).orderBy(F.desc(out))


def most_common(df: DataFrame, by: Sequence[Column], having: Column | None, k: int) -> DataFrame:
    """Counts of the groups that pass `having`, in group order, first `k`."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if having is not None:
        counts = counts.filter(having)
    return counts.orderBy(*[c for c in counts.columns if c != "n"]).limit(k)


def percent_present(df: DataFrame, by: Sequence[str], present: Column) -> DataFrame:
    """Whole percent of rows with `present` = 1 among those where it is known."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(present.cast("double")), 0).alias("pct_present")
    )


def load_report(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each loaded table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
