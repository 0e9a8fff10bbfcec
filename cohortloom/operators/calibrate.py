"""Rates that follow a value: scores calibrated by isotonic regression, and smoothed rates by local regression.

Both start from one row per distinct value, so ties and hot values cost nothing later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import written_once
from .curve import MAX_WINDOW_ROWS
from .running import running_segments, segment_edges, with_segment


def corners(points: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The corners of the least concave line over points with ascending first part; points on the line between two corners are none."""
    kept: list[tuple[int, int]] = []
    for x, y in points:
        while len(kept) > 1:
            (x0, y0), (x1, y1) = kept[-2:]
            if (y1 - y0) * (x - x1) > (y - y1) * (x1 - x0):
                break
            kept.pop()
        kept.append((x, y))
    return kept


def isotonic_scores(curve: DataFrame, by: Sequence[str] = (), max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Per group and distinct score of a threshold curve: cutoff, n, pos, rate; of all rates that never fall as the score rises the closest by squares.

    These are the slopes of the least concave line over (rows, positives) counted from the highest score down. Its corners are
    first found in segments of the score range and then among the corners of all segments. Slopes between corners are distinct
    fractions, so N rows leave at most about N^(2/3) corners, which one task per group takes. Blocks of equal rate are pooled.
    Scores that are not a number are left out; groups may be null; an empty curve gives an empty result.
    """
    by = list(by)
    n = F.col("pos") + F.col("neg")
    points = written_once(curve.filter(~F.isnan("cutoff")).select(*by, "cutoff", "pos", n.alias("n"), (F.col("tp") + F.col("fp")).alias("_x"), F.col("tp").alias("_y")))
    edges = segment_edges(points, "cutoff", points.count() // max_window_rows + 1)
    cut = with_segment(points, "cutoff", edges)
    fields = [points.schema[c] for c in by]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def in_segment(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_x")
        found = corners(zip(rows["_x"].tolist(), rows["_y"].tolist(), strict=True))
        return _grouped(rows, by, {"_x": [x for x, _ in found], "_y": [y for _, y in found]})

    def in_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_x")
        found = corners([(0, 0), *zip(rows["_x"].tolist(), rows["_y"].tolist(), strict=True)])
        pairs = list(zip(found, found[1:], strict=False))
        return _grouped(rows, by, {"_end": [b[0] for _, b in pairs], "_rate": [(b[1] - a[1]) / (b[0] - a[0]) for a, b in pairs]})

    some = cut.select(*by, "_segment", "_x", "_y").groupBy(*by, "_segment").applyInPandas(in_segment, f"{kinds}_x long, _y long")
    # a constant beside the groups, so that there is a key without groups too
    ends = some.withColumn("_all", F.pmod("_x", F.lit(1))).groupBy(*by, "_all").applyInPandas(in_group, f"{kinds}_end long, _rate double")
    ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in by], "_end", "_rate")
    on = F.col("_x") == F.col("_end")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    # a block ends at its lowest score, and rates rise with the score: going up, the highest rate so far is that of the own block
    marked = cut.join(ends, on, "left").select(*by, "cutoff", "n", "pos", "_segment", F.col("_rate").alias("rate"))
    return running_segments(marked, by, ["cutoff"], maxes=["rate"]).drop("_segment")


def _grouped(rows: pd.DataFrame, by: Sequence[str], columns: dict[str, list]) -> pd.DataFrame:
    """The columns beside the group that all rows share."""
    size = len(next(iter(columns.values())))
    return pd.DataFrame({c: rows[c].iloc[[0] * size].reset_index(drop=True) for c in by} | columns)


def smooth_rate(df: DataFrame, value: str, label: str, step: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Local linear regression of the rate at the multiples of `step`: at, n (rows in reach), rate (within 0 to 1).

    Rows nearer than `width` count with the tricube weight (1 - (distance / width)^3)^3. Each distinct value goes to the
    points in its reach, at most 2 * width / step + 1 of them, and the points sum what they get: one aggregation, combined
    before the shuffle. Where all of the weight lies on one value the rate is its mean. Points with values on one
    side only are left out, so the ends are not extrapolated. Rows without value or label, and values that are not finite, are left out.
    """
    x = F.col(value).cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & F.col(label).isNotNull()
    counts = df.filter(usable).groupBy(*by, x.alias("_x")).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_y"))
    points = F.sequence(F.ceil((F.col("_x") - width) / step), F.floor((F.col("_x") + width) / step))
    # a sequence would run backwards where no point is in reach
    points = F.when(F.ceil((F.col("_x") - width) / step) <= F.floor((F.col("_x") + width) / step), points).otherwise(F.array().cast("array<bigint>"))
    near = counts.withColumn("_k", F.explode(points)).withColumn("_d", F.col("_x") - F.col("_k") * F.lit(float(step)))
    near = near.filter(F.abs("_d") < width).withColumn("_w", F.pow(1 - F.pow(F.abs("_d") / width, 3), 3))
    w, n, y, d = F.col("_w"), F.col("_n"), F.col("_y"), F.col("_d")
    sums = near.groupBy(*by, "_k").agg(
        F.sum(n).alias("n"), F.sum(w * n).alias("s0"), F.sum(w * n * d).alias("s1"), F.sum(w * n * d * d).alias("s2"),
        F.sum(w * y).alias("t0"), F.sum(w * y * d).alias("t1"), F.min(d).alias("low"), F.max(d).alias("high"),
    ).filter("low <= 0 and high >= 0")
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    free = s0 * s2 - s1 * s1
    fit = F.when(free > 1e-9 * s0 * s2, (s2 * t0 - s1 * t1) / free).otherwise(t0 / s0)
    return sums.select(*by, (F.col("_k") * F.lit(float(step))).alias("at"), "n", F.least(F.greatest(fit, F.lit(0.0)), F.lit(1.0)).alias("rate"))
