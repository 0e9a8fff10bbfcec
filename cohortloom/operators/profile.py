"""Exact profile of numeric columns: information, mean, Gini's mean difference, quantiles, lowest and highest values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_once
from .running import running_segments, running_window, segment_edges, with_segment

QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
SEGMENT_ROWS = 2_000_000


def numeric_profile(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = QUANTILES, extremes: int = 5, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per column: n, missing, distinct, info, mean, gmd, one column per quantile (q05, q50, ...), lowest and highest values (arrays).

    Quantiles interpolate between the two order statistics around (n - 1) q. Info is 1 for a column without ties and 0 for a
    constant one; gmd is the mean difference of two rows. Everything follows from counts per value and their running sum, which is
    made in segments of the value range, so no column is sorted in one task. NaN counts as missing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(each.alias("_c")).select("_c.column", F.when(~F.isnan("_c.value"), F.col("_c.value")).alias("value"))
    counts = written_once(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")))
    known = counts.filter("value is not null").withColumn("upto", F.col("c"))
    segments = math.ceil(known.count() / segment_rows)
    if segments > 1:
        run = running_segments(with_segment(known, "value", segment_edges(known, "value", segments)), ["column"], ["value"], ["upto"]).drop("_segment")
    else:
        run = running_window(known, ["column"], ["value"], ["upto"], [])
    # one row per column
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("missing")
    )
    rows = run.join(F.broadcast(totals.select(F.col("column").alias("_column"), "n")), F.col("column") == F.col("_column"))
    before, c, v, n = F.col("upto") - F.col("c"), F.col("c"), F.col("value"), F.col("n").cast("double")

    def order_statistic(rank: Column) -> Column:
        """The value at a rank from 0."""
        return F.max(F.when((before <= rank) & (rank < F.col("upto")), v))

    found = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.pow(c / n, F.lit(3.0))).alias("_cubes"),
        (F.sum(v * c) / F.first("n")).alias("mean"),
        F.sum(v * c * (2 * before + c - n)).alias("_spread"),
        *[order_statistic(F.floor((F.col("n") - 1) * F.lit(q))).alias(f"_low{k}") for k, q in enumerate(quantiles)],
        *[order_statistic(F.ceil((F.col("n") - 1) * F.lit(q))).alias(f"_high{k}") for k, q in enumerate(quantiles)],
    )
    both = totals.join(found, "column", "left")
    for order, name in ((F.col("value").asc(), "lowest"), (F.col("value").desc(), "highest")):
        both = both.join(_ends(known.select("column", "value"), extremes, order, name), "column", "left")
    part = [((F.col("n") - 1) * F.lit(q)) - F.floor((F.col("n") - 1) * F.lit(q)) for q in quantiles]
    points = [(F.col(f"_low{k}") + p * (F.col(f"_high{k}") - F.col(f"_low{k}"))).alias(f"q{round(100 * q):02d}") for k, (q, p) in enumerate(zip(quantiles, part))]
    info = F.when(F.col("n") > 1, (1 - F.col("_cubes")) / (1 - 1 / (F.col("n").cast("double") * F.col("n"))))
    gmd = F.when(F.col("n") > 1, 2 * F.col("_spread") / (F.col("n").cast("double") * (F.col("n") - 1)))
    return both.select("column", "n", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"), info.alias("info"), "mean", gmd.alias("gmd"), *points, "lowest", "highest")


def _ends(known: DataFrame, k: int, order: Column, name: str) -> DataFrame:
    """column and the `k` first distinct values in `order`, ascending. Each task hands on no more than `k` per column."""
    first = known.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy(order))).filter(F.col("_k") <= k)
    return first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias(name))
