"""The threshold table of a score: counts at every distinct score, from high to low.

Rows are first summed per distinct score, so ties and repeated scores cost
nothing later. The sums are stored, and the running sums over the distinct scores are made in segments of the score range,
as many as the number of distinct scores asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written_once
from .running import running_window, segment_edges, with_segment

MAX_WINDOW_ROWS = 1_000_000


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: rows with label 1 and with label 0.

    Rows without score or label are counted as `missing` in one row per group whose cutoff is null.
    """
    known = F.col(score).isNotNull() & F.col(label).isNotNull()
    cutoff = F.when(known, F.col(score).cast("double"))
    return df.groupBy(*by, cutoff.alias("cutoff")).agg(
        F.count_if(known & (F.col(label) == 1)).alias("pos"), F.count_if(known & (F.col(label) != 1)).alias("neg"), F.count_if(~known).alias("missing")
    )


def threshold_curve(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), max_window_rows: int = MAX_WINDOW_ROWS, keep_missing: bool = False
) -> DataFrame:
    """One row per group and distinct score c, for the rule "positive if score >= c".

    Columns: cutoff, pos, neg (at this score), next_pos (at the next lower score),
    tp, fp, fn, tn, n_pos, n_neg, rpp, sens, spec, ppv, npv. With `keep_missing`
    also `missing` and the rows with a null cutoff that carry it.
    """
    by = list(by)
    points = score_counts(df, score, label, by).withColumn("_position", F.coalesce(-F.col("cutoff"), F.lit(float("-inf"))))
    # Written down once: the number of segments, their edges and totals and the rows all read it.
    points = written_once(points)
    run = _by_segment(points, by, segment_edges(points, "_position", 2 * points.count() // max_window_rows + 1))
    rated = with_rates(run).drop("_position")
    return rated if keep_missing else rated.filter(F.col("cutoff").isNotNull()).drop("missing")


def _by_segment(points: DataFrame, by: list[str], edges: list[float]) -> DataFrame:
    """Running sums inside each segment, moved on by the segments before; looks ahead one score over the border."""
    cut = with_segment(points, "_position", edges)
    groups = [*by, "_segment"]
    ahead, whole = Window.partitionBy(*by).orderBy("_segment"), Window.partitionBy(*by)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    # At most groups x segments rows.
    ends = cut.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_f"), F.min_by("pos", "_position").alias("_first")).select(
        *[F.col(c).alias(f"_e_{c}") for c in groups],
        F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_fp"),
        F.sum("_p").over(whole).alias("n_pos"), F.sum("_f").over(whole).alias("n_neg"), F.lead("_first").over(ahead).alias("_following"),
    )
    on = F.col("_segment") == F.col("_e__segment")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    ordered = Window.partitionBy(*groups).orderBy("_position")
    local = cut.withColumns({"tp": F.col("pos"), "fp": F.col("neg"), "next_pos": F.lead("pos").over(ordered)})
    joined = running_window(local, groups, ["_position"], ["tp", "fp"], []).join(ends, on)
    return joined.withColumns({
        "tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp"), "next_pos": F.coalesce("next_pos", "_following"),
    }).drop("_tp", "_fp", "_following", "_segment", *[f"_e_{c}" for c in groups])


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from tp, fp, n_pos, n_neg; a rate with nothing below the line is null."""
    def ratio(a, b):
        return F.when(b > 0, a / b)

    tp, fp = F.col("tp"), F.col("fp")
    out = counts.withColumns({"fn": F.col("n_pos") - tp, "tn": F.col("n_neg") - fp})
    return out.withColumns({
        "rpp": ratio(tp + fp, F.col("n_pos") + F.col("n_neg")),
        "sens": ratio(tp, F.col("n_pos")),
        "spec": ratio(F.col("tn"), F.col("n_neg")),
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(F.col("tn"), F.col("tn") + F.col("fn")),
    })
