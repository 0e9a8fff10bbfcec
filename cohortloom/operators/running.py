"""Running sums and maxima that do not need a whole group in one task.

A plain window sorts a whole partition key in one task. Where that is too much
the rows are cut into segments along the ordering column; every segment runs on
its own and is then shifted by what the segments before it add up to. The table
of segment totals has at most (groups x segments) rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

def segment_edges(df: DataFrame, position: str, segments: int) -> list[float]:
    """Inner edges that cut `position` into about equal parts: one number per segment, on the driver.

    They decide only how even the segments are: every row of `df` is in some segment whatever the edges.
    """
    if segments <= 1:
        return []
    shares = [i / segments for i in range(1, segments)]
    row = df.agg(F.percentile_approx(F.col(position).cast("double"), shares, max(10_000, 10 * segments)).alias("e")).first()
    return sorted({e for e in row["e"] or [] if math.isfinite(e)})


def with_segment(df: DataFrame, position: str, edges: Sequence[float], out: str = "_segment") -> DataFrame:
    """Number the segments 0, 1, ... in ascending order of `position`."""
    if not edges:
        # 0, but not as a constant, which would fold a later join on it into a nested loop
        return df.withColumn(out, F.pmod(F.xxhash64(F.col(position)), F.lit(1)).cast("int"))
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_cut_in", outputCol=out, handleInvalid="keep")
    return (
        cut.transform(df.withColumn("_cut_in", F.col(position).cast("double")))
        .withColumn(out, F.col(out).cast("int"))
        .drop("_cut_in")
    )


def running_window(df: DataFrame, by: Sequence[str], order: Sequence, sums: Sequence[str], maxes: Sequence[str]) -> DataFrame:
    """Replace each listed column by its running value over the ordered rows of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {c: F.sum(c).over(w) for c in sums} | {c: F.max(c).over(w) for c in maxes}
    return df.withColumns(cols)


def running_segments(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    segment: str = "_segment",
    valued: DataFrame | None = None,
) -> DataFrame:
    """Same result as `running_window`, one task per (group, segment).

    What the segments before add up to stands in a row of its own at the head of each segment, so that the rows themselves are
    shuffled and sorted once. `valued`, for maxima alone: the rows of `df` that have a value, where most have none.
    """
    by = list(by)
    if valued is None:
        totals = df.groupBy(*by, segment).agg(*[F.sum(c).alias(f"_before_{c}") for c in sums], *[F.max(c).alias(c) for c in maxes]).withColumn("_here", F.lit(True))
    else:
        some = valued.groupBy(*by, segment).agg(*[F.max(c).alias(c) for c in maxes]).withColumn("_here", F.lit(False))
        totals = df.select(*by, segment).distinct().withColumn("_here", F.lit(True)).unionByName(some, allowMissingColumns=True)
    earlier = Window.partitionBy(*by).orderBy(segment).rangeBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"_before_{c}": F.sum(f"_before_{c}").over(earlier) for c in sums} | {c: F.max(c).over(earlier) for c in maxes})
    heads = carry.filter("_here").drop("_here").withColumn("_after_head", F.lit(0))
    rows = df.withColumn("_after_head", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*by, segment).orderBy("_after_head", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The sum before is added to a sum of the segment's own: the same additions whatever the segment holds.
    cols = {c: F.sum(c).over(w) + F.coalesce(F.first(f"_before_{c}").over(w), F.lit(0)) for c in sums} | {c: F.max(c).over(w) for c in maxes}
    return rows.withColumns(cols).filter("_after_head = 1").select(*df.columns)
