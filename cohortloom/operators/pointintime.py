"""What held at, or happened around, an instant of each entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import regex_flag
from ..functions.time import hours_after
from .codes import WARD_PATTERNS
from .dedupe import first_row_per_key
from .skew import HOT_ROWS, salted_join


def state_at(
    anchors: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    *,
    anchor: str,
    hours: int,
    start: str,
    end: str,
    tie: Sequence[str | Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The interval that contains `anchor + hours`, both ends excluded; one row per anchor key.

    `anchors` holds one row per key. A key with no such interval has no row, an
    interval without an end never matches, and of overlapping ones the first
    by `start`, then `tie`, is kept.
    """
    probe = anchors.withColumn("_probe", hours_after(F.col(anchor), hours))
    inside = (F.col(start) < F.col("_probe")) & (F.col(end) > F.col("_probe"))
    hit = salted_join(intervals, probe, keys, spread_on=[start, end], condition=inside, min_rows=hot_rows)
    return first_row_per_key(hit, keys, [start, *tie]).drop("_probe")


def band_join(
    events: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    *,
    ts: str,
    anchor: str,
    tie: str,
    hours: int = 24,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Events less than `hours` before or after the anchor of their key, both ends excluded.

    `anchors` holds one row per key, so an event is returned at most once.
    """
    near = (F.col(ts) < hours_after(F.col(anchor), hours)) & (F.col(ts) > hours_after(F.col(anchor), -hours))
    return salted_join(events, anchors, keys, spread_on=[ts, tie], condition=near, min_rows=hot_rows)


def near_any_anchor(
    events: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    *,
    ts: str,
    anchor: str,
    tie: str,
    hours: int = 24,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Events less than `hours` from at least one of the many anchors of their key, each once.

    No pairs are built. Time is cut into slots as wide as the band: an anchor in the
    event's own slot is always near, and of the slots beside it only the last anchor
    before and the first anchor after can be.
    """
    keys, width = list(keys), hours * 3600 * 1_000_000

    def slot(name: str) -> Column:
        return F.floor(F.unix_micros(F.col(name).cast("timestamp")) / F.lit(width)).cast("long")

    ends = anchors.groupBy(*keys, slot(anchor).alias("_slot")).agg(F.min(anchor).alias("_low"), F.max(anchor).alias("_high"))
    reach = ends.select(*keys, "_low", "_high", F.explode(F.array(*[
        F.struct((F.col("_slot") + d).alias("_slot"), F.lit(d).alias("_step")) for d in (-1, 0, 1)
    ])).alias("_r")).select(*keys, "_low", "_high", "_r.*")
    around = reach.groupBy(*keys, "_slot").agg(
        F.max(F.col("_step") == 0).alias("_here"),
        F.max(F.when(F.col("_step") == 1, F.col("_high"))).alias("_before"),
        F.min(F.when(F.col("_step") == -1, F.col("_low"))).alias("_after"),
    )
    near = F.col("_here") | (F.col(ts) < hours_after(F.col("_before"), hours)) | (F.col(ts) > hours_after(F.col("_after"), -hours))
    placed = events.withColumn("_slot", slot(ts))
    joined = salted_join(placed, around, [*keys, "_slot"], spread_on=[ts, tie], condition=near, min_rows=hot_rows)
    return joined.select(*events.columns)


def first_state(intervals: DataFrame, keys: Sequence[str], *, start: str, tie: Sequence[str | Column], keep: Mapping[str, str]) -> DataFrame:
    """First interval of each key, as `keep = {new name: column}`."""
    return first_row_per_key(intervals, keys, [start, *tie]).select(*keys, *[F.col(c).alias(n) for n, c in keep.items()])


def ward_flags(*wards: Column, patterns: Mapping[str, str] = WARD_PATTERNS) -> dict[str, Column]:
    """One 0/1 column per pattern: was any of the given wards of that kind."""
    return {name: regex_flag(p, *[F.lower(w) for w in wards]) for name, p in patterns.items()}


def match_audit(left: DataFrame, right: DataFrame, on: Sequence[str], *, left_ts: str, right_ts: str) -> DataFrame:
    """How many rows of `left` found a partner, and how the two dates compare. `right` has one row per key."""
    both = left.join(right.withColumn("_matched", F.lit(1)), list(on), "left")
    found = F.col("_matched").isNotNull()
    a, b = F.col(left_ts), F.col(right_ts)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~found).alias("n_unmatched"),
        F.count_if(found & (a == b)).alias("n_same"),
        F.count_if(found & (a < b)).alias("n_left_earlier"),
        F.count_if(found & (a > b)).alias("n_left_later"),
    )
