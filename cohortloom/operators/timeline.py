"""What held at many instants of a key, and pairs of rows near each other in time, without a join on the key alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_once
from .running import running_segments, running_window, segment_edges, with_segment
from .skew import HOT_ROWS, salted_join


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, hot_rows: int, valued: DataFrame | None = None) -> DataFrame:
    """Running maximum of `column`; where a key has more than `hot_rows` rows, in segments of the first ordering column.

    `valued`: the rows of `df` whose `column` is not null, where they are few.
    """
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= hot_rows:
        return running_window(df, keys, order, [], [column])
    edges = segment_edges(df, order[0], math.ceil(most / hot_rows))
    few = None if valued is None else with_segment(valued, order[0], edges)
    return running_segments(with_segment(df, order[0], edges), keys, order, maxes=[column], valued=few).drop("_segment")


def states_at(
    probes: DataFrame, intervals: DataFrame, keys: Sequence[str], *, at: str, start: str, end: str, tie: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every probe with start, end and `tie` (a whole number) of the interval of its key that contains its instant, both ends excluded.

    A key may have any number of probes and of intervals, which may overlap: of those that contain the instant, the first by
    start, then by end (the later one), then by `tie` is returned. A probe that no interval contains has nulls; intervals without
    an end never match.

    No pairs are built. An interval that ends no later than one that started before it is never the first; the others end in
    the order in which they start, so the answer is the next of their ends after the instant, if that one has started: one
    running maximum to find them, one over the timeline of ends and instants. Keys of more than `hot_rows` rows are cut into
    time segments.
    """
    keys = list(keys)
    rows = intervals.select(*keys, _micros(start).alias("_s"), _micros(end).alias("_e"), F.col(tie).cast("long").alias("_t"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    rows = rows.dropna(subset=[*keys, "_s", "_e"]).filter("_s < _e")
    own = F.struct("_e", (-F.col("_s")).alias("s"), (-F.col("_t")).alias("t"))
    first = _running(rows.withColumns({"_top": own, "_late": -F.col("_e")}), keys, ["_s", "_late", "_t"], "_top", hot_rows)
    held = F.struct((-F.col("_e")).alias("e"), "_s", F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_t").alias("t"))
    # Written down once: the row counts, the edges, the segment totals and the timeline all read it.
    ends = written_once(first.filter(F.col("_top") == own).select(*keys, "_e", held.alias("_held")))
    kind = ends.schema["_held"].dataType
    asked = probes.select(*keys, (-_micros(at)).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_held"), F.struct(*probes.columns).alias("_probe"))
    marks = ends.select(*keys, (-F.col("_e")).alias("_at"), F.lit(1).alias("_kind"), "_held", F.lit(None).cast(asked.schema["_probe"].dataType).alias("_probe"))
    # backwards in time: what an instant has seen last is the next end after it
    line = _running(asked.union(marks), keys, ["_at", "_kind"], "_held", hot_rows, valued=marks).filter("_kind = 0")
    inside = F.col("_held._s") < -F.col("_at")
    return line.select("_probe.*", F.when(inside, F.col("_held.start")).alias(start), F.when(inside, F.col("_held.end")).alias(end), F.when(inside, F.col("_held.t")).alias(tie))


def band_pairs(
    events: DataFrame, anchors: DataFrame, keys: Sequence[str], *, ts: str, anchor: str, tie: str, hours: int = 24, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All pairs of an event and an anchor of its key less than `hours` apart, both ends excluded; any number of either per key.

    Time is cut into slots as wide as the band. An event stands in its own slot, an anchor in its own and the two beside it, so
    each pair is made in exactly one slot and rows far apart never meet. The events of busy slots are spread over tasks.
    """
    keys, width = list(keys), hours * 3600 * 1_000_000

    def slot(name: str) -> Column:
        return F.floor(_micros(name) / F.lit(width)).cast("long")

    placed = events.withColumn("_slot", slot(ts))
    around = anchors.withColumn("_slot", F.explode(F.array(*[slot(anchor) + d for d in (-1, 0, 1)])))
    near = F.abs(_micros(ts) - _micros(anchor)) < width
    return salted_join(placed, around, [*keys, "_slot"], spread_on=[ts, tie], condition=near, min_rows=hot_rows).drop("_slot")
