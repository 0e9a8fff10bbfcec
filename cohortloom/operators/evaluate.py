"""How good a score is. The positive class is always label = 1."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import cost_ratio
from .curve import threshold_curve, with_rates


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _concordant() -> Column:
    """Pairs (positive, negative) in the right order, ties counted half, from curve rows."""
    return F.sum(F.col("pos") * ((F.col("n_neg") - F.col("fp")) + 0.5 * F.col("neg")))


def c_statistic(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """C (exact area under the ROC curve), Dxy = 2(C - 1/2), rows used and rows with a missing value, per group.

    C is null when a group has only one class.
    """
    curve = threshold_curve(df, score, label, by, keep_missing=True)
    sums = curve.groupBy(*by).agg(
        _concordant().alias("_pairs"), F.max(F.col("n_pos").cast("double") * F.col("n_neg")).alias("_all"),
        F.max(F.col("n_pos") + F.col("n_neg")).alias("n"), F.sum("missing").alias("missing"),
    )
    c = _ratio(F.col("_pairs"), F.col("_all"))
    return sums.select(*by, c.alias("c"), (2 * (c - 0.5)).alias("dxy"), "n", "missing")


def confusion_counts(df: DataFrame, score: str, label: str, cutoff: float, by: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """tp, fp, fn, tn for "positive if score > cutoff" (>= if `inclusive`)."""
    s, y = F.col(score), F.col(label) == 1
    hit = (s >= cutoff) if inclusive else (s > cutoff)
    known = df.filter(s.isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )


def confusion_stats(counts: DataFrame) -> DataFrame:
    """All derived statistics of a table of tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    sens, spec, acc = _ratio(tp, tp + fn), _ratio(tn, fp + tn), _ratio(tp + tn, n)
    ppv = _ratio(tp, tp + fp)
    return counts.withColumns({
        "accuracy": acc,
        "no_information_rate": _ratio(F.greatest(tp + fn, fp + tn), n),
        "kappa": _ratio(acc - chance, 1 - chance),
        "mcnemar": F.when(fp + fn > 0, F.pow(F.abs(fp - fn) - 1, F.lit(2)) / (fp + fn)),
        "sens": sens,
        "spec": spec,
        "ppv": ppv,
        "npv": _ratio(tn, tn + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "prevalence": _ratio(tp + fn, n),
        "detection_rate": _ratio(tp, n),
        "detection_prevalence": _ratio(tp + fp, n),
        "balanced_accuracy": (sens + spec) / 2,
    })


def exact_tests(stats: DataFrame) -> DataFrame:
    """Add the exact binomial 95 % interval of the accuracy and the two p-values to `confusion_stats` rows."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = ("accuracy_lower", "accuracy_upper", "p_accuracy_above_nir", "p_mcnemar")
    out = StructType([StructField(n, DoubleType()) for n in names])

    @F.pandas_udf(out)
    def tests(right: pd.Series, total: pd.Series, nir: pd.Series, chi: pd.Series) -> pd.DataFrame:
        rows = [
            (*_exact_interval(int(k), int(n)), _upper_tail(int(k), int(n), p), math.nan if pd.isna(x) else math.erfc(math.sqrt(x / 2)))
            for k, n, p, x in zip(right, total, nir, chi)
        ]
        return pd.DataFrame(rows, columns=list(names))

    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return stats.withColumn("_t", tests(F.col("tp") + F.col("tn"), total, F.col("no_information_rate"), F.col("mcnemar"))).select(
        *stats.columns, *[F.col(f"_t.{n}").alias(n) for n in names]
    )


MOST_STEPS = 100_000_000  # enough for counts of 10^15


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction, which needs about sqrt(a + b) steps."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, MOST_STEPS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            return front * f
    raise ArithmeticError(f"no limit within {MOST_STEPS} steps for counts {a} and {b}")


def _exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    def solve(share: float, a: float, b: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _beta_cdf(mid, a, b) < share else (low, mid)
        return (low + high) / 2

    side = (1 - level) / 2
    return (0.0 if k == 0 else solve(side, k, n - k + 1)), (1.0 if k == n else solve(1 - side, k + 1, n - k))


def _upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p)."""
    return 1.0 if k == 0 else _beta_cdf(p, k, n - k + 1)


def at_thresholds(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Counts and rates at each of a short list of thresholds: one aggregation, nothing repeated per threshold."""
    s, y = F.col(score), F.col(label) == 1
    known = df.filter(s.isNotNull() & F.col(label).isNotNull())
    hits = [(s >= t) if inclusive else (s > t) for t in thresholds]
    wide = known.groupBy(*by).agg(
        F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"),
        *[F.count_if(h & y).alias(f"_tp{i}") for i, h in enumerate(hits)],
        *[F.count_if(h & ~y).alias(f"_fp{i}") for i, h in enumerate(hits)],
    )
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ]
    return with_rates(wide.select(*by, "n_pos", "n_neg", F.inline(F.array(*rows))))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """prob_threshold, sens, spec, j = sens + spec - 1 and the distance to the perfect corner."""
    rows = at_thresholds(df, score, label, thresholds, by)
    dist = F.sqrt(F.pow(1 - F.col("sens"), F.lit(2)) + F.pow(1 - F.col("spec"), F.lit(2)))
    return rows.select(
        *by, F.col("threshold").alias("prob_threshold"), "sens", "spec",
        (F.col("sens") + F.col("spec") - 1).alias("j"), dist.alias("dist"),
    )


def metric_bundle(df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """threshold, metric, value in long form for the score cut at "> threshold"."""
    r = at_thresholds(df, score, label, thresholds, by, inclusive=False)
    n = F.col("n_pos") + F.col("n_neg")
    acc = _ratio(F.col("tp") + F.col("tn"), n)
    metrics = {
        "f": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "auc": (F.col("sens") + F.col("spec")) / 2,
        "ppv": F.col("ppv"), "npv": F.col("npv"), "sens": F.col("sens"), "spec": F.col("spec"),
        "acc": acc, "err": 1 - acc, "rpp": F.col("rpp"),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return r.select(*by, "threshold", F.inline(rows))


def two_class_summary(df: DataFrame, score: str, label: str, cutoff: float, by: Sequence[str] = ()) -> DataFrame:
    """ROC area, and sensitivity and specificity of "score > cutoff", per group."""
    curve = threshold_curve(df, score, label, by)
    above = F.col("cutoff") > cutoff
    agg = curve.groupBy(*by).agg(
        _concordant().alias("_pairs"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n"),
        F.coalesce(F.max(F.when(above, F.col("tp"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.max(F.when(above, F.col("fp"))), F.lit(0)).alias("_fp"),
    )
    return agg.select(
        *by, _ratio(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n")).alias("roc"),
        _ratio(F.col("_tp"), F.col("_p")).alias("sens"), _ratio(F.col("_n") - F.col("_fp"), F.col("_n")).alias("spec"),
    )


POINT = ("cutoff", "sens", "spec", "ppv")


def _point(*first: Column) -> Column:
    return F.struct(*first, *[F.col(c) for c in POINT])


def best_threshold(curve: DataFrame, by: Sequence[str] = (), prevalence: float | None = None, cost: float = 1.0) -> DataFrame:
    """The curve point with the highest sens + w * spec; the lower cutoff on a tie.

    w is 1 (Youden), or the cost ratio when a prevalence is given.
    """
    w = 1.0 if prevalence is None else cost_ratio(prevalence, cost)
    goal = F.round(F.col("sens") + w * F.col("spec"), 12)
    best = curve.groupBy(*by).agg(F.max(_point(goal.alias("objective"), (-F.col("cutoff")).alias("_low"))).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in POINT], F.col("_b.objective").alias("objective"))


def local_maxima(curve: DataFrame) -> DataFrame:
    """Upper corners of the ROC curve: sensitivity rises at this score and not at the next lower one."""
    return curve.filter((F.col("pos") > 0) & F.coalesce(F.col("next_pos") == 0, F.lit(True)))


def alert_cutoffs(curve: DataFrame, rates: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per wanted alert rate the lowest cutoff whose rate stays strictly below it, with its rates."""
    wide = curve.groupBy(*by).agg(*[F.min(F.when(F.col("rpp") < r, _point())).alias(f"_c{i}") for i, r in enumerate(rates)])
    rows = [
        F.struct(F.lit(float(r)).alias("alert_rate"), *[F.col(f"_c{i}")[c].alias(c) for c in POINT]) for i, r in enumerate(rates)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def first_cutoff_above(curve: DataFrame, rate: float, by: Sequence[str] = ()) -> DataFrame:
    """The highest cutoff whose alert rate is strictly above `rate`."""
    return curve.groupBy(*by).agg(F.max(F.when(F.col("rpp") > rate, F.col("cutoff"))).alias("cutoff"))


def break_even(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The point where precision and recall are closest; the higher cutoff on a tie."""
    gap = F.round(F.abs(F.col("ppv") - F.col("sens")), 12)
    best = curve.groupBy(*by).agg(F.min(_point(gap.alias("gap"), (-F.col("cutoff")).alias("_high"))).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in POINT], F.col("_b.gap").alias("gap"))


def area_under_pr(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, level before the first point."""
    before = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    previous = F.when(before > 0, (F.col("tp") - F.col("pos")) / before).otherwise(F.col("ppv"))
    slab = _ratio(F.col("pos"), F.col("n_pos")) * (F.col("ppv") + previous) / 2
    return curve.groupBy(*by).agg(F.sum(slab).alias("aucpr"))


def calibration(curve: DataFrame, by: Sequence[str] = (), groups: int = 10) -> DataFrame:
    """Mean score against observed rate in `groups` equal parts of the rows, highest scores first.

    Rows with one score stay together, in the part where the first of them falls.
    """
    size = F.col("pos") + F.col("neg")
    before = F.col("tp") + F.col("fp") - size
    part = (F.floor(before * groups / (F.col("n_pos") + F.col("n_neg"))) + 1).cast("int")
    sums = curve.groupBy(*by, part.alias("part")).agg(
        F.sum(size).alias("n"), F.sum(F.col("cutoff") * size).alias("_s"), F.sum("pos").alias("_y")
    )
    mean, seen = F.col("_s") / F.col("n"), F.col("_y") / F.col("n")
    return sums.select(*by, "part", "n", mean.alias("mean_score"), seen.alias("observed"), F.abs(mean - seen).alias("error"))
