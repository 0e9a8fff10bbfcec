"""Snapshot panels: one row per entity and hour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import hash_text
from .dedupe import first_row_per_key
from .skew import HOT_ROWS, salted_join

# The snapshot hours.
SNAPSHOT_HOURS = (1, 3, 6, 12, 24)


def snapshot_panel(
    events: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    *,
    ts: str,
    anchor: str,
    tie: str,
    measures: Mapping[str, Column],
    hours: Sequence[int] = SNAPSHOT_HOURS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """First, last, lowest, highest and mean value and change of every measure from `anchor` up to each hour.

    One pass: an event is put in the first hour it counts for, aggregated per
    (entity, hour) with map-side combine, and the few hour rows of an entity
    are then merged cumulatively. Events are not repeated per hour. A missing
    measurement is skipped. With a whole number as `tie` time and tie are one
    number of fixed width, which hash aggregation takes; other ties sort.
    """
    parts = snapshot_parts(events, anchors, keys, ts=ts, anchor=anchor, tie=tie, measures=measures, hours=hours, hot_rows=hot_rows)
    return panel_of_parts(parts, keys, list(measures), hours)


def snapshot_parts(
    events: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    *,
    ts: str,
    anchor: str,
    tie: str,
    measures: Mapping[str, Column],
    hours: Sequence[int] = SNAPSHOT_HOURS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What some of the events add to the panel: one row per entity and first hour. Parts of other events go under it."""
    keys, hours = list(keys), sorted(hours)
    joined = salted_join(
        events, anchors, keys, spread_on=[ts, tie], min_rows=hot_rows,
        condition=(F.col(ts) >= F.col(anchor)) & (F.col(ts) <= F.col(anchor) + F.make_dt_interval(hours=F.lit(hours[-1]))),
    )
    slot = None
    for h in hours:
        test = F.col(ts) <= F.col(anchor) + F.make_dt_interval(hours=F.lit(h))
        slot = F.when(test, h) if slot is None else slot.when(test, h)
    if isinstance(events.schema[tie].dataType, T.IntegralType):
        width = F.lit("10000000000000000000").cast("decimal(20,0)")  # more than any 64-bit tie
        at = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)") * width + F.col(tie).cast("decimal(19,0)")
    else:
        at = F.struct(F.col(ts), F.col(tie))
    rows = joined.select(*keys, slot.alias("_hour"), at.alias("_at"), *[v.alias(f"_v_{n}") for n, v in measures.items()])

    parts = []
    for n in measures:
        v = F.col(f"_v_{n}")
        when = F.when(v.isNotNull(), F.col("_at"))
        parts += [
            F.min_by(v, when).alias(f"_first_{n}"), F.min(when).alias(f"_begin_{n}"), F.max_by(v, when).alias(f"_last_{n}"), F.max(when).alias(f"_end_{n}"),
            F.min(v).alias(f"_min_{n}"), F.max(v).alias(f"_max_{n}"), F.sum(v).alias(f"_sum_{n}"), F.count(v).alias(f"_n_{n}"),
        ]
    return rows.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"), *parts)


def panel_of_parts(parts: DataFrame, keys: Sequence[str], measures: Sequence[str], hours: Sequence[int] = SNAPSHOT_HOURS) -> DataFrame:
    """The panel from the parts of all events, however they were cut."""
    keys, hours = list(keys), sorted(hours)

    def upto(how, name: str, h: int) -> Column:
        return how(F.when(F.col("_hour") <= h, F.col(name)))

    def row(h: int) -> Column:
        fields = [F.lit(h).alias("hour"), F.coalesce(upto(F.sum, "_n", h), F.lit(0)).alias("n_events")]
        for n in measures:
            first = F.min_by(f"_first_{n}", F.when(F.col("_hour") <= h, F.col(f"_begin_{n}")))
            last = F.max_by(f"_last_{n}", F.when(F.col("_hour") <= h, F.col(f"_end_{n}")))
            fields += [
                first.alias(f"{n}_first"), last.alias(f"{n}_last"),
                upto(F.min, f"_min_{n}", h).alias(f"{n}_min"), upto(F.max, f"_max_{n}", h).alias(f"{n}_max"),
                (upto(F.sum, f"_sum_{n}", h) / upto(F.sum, f"_n_{n}", h)).alias(f"{n}_mean"),
                (last - first).alias(f"{n}_change"),
            ]
        return F.struct(*fields)

    return parts.groupBy(*keys).agg(F.array(*[row(h) for h in hours]).alias("_rows")).select(*keys, F.inline("_rows"))


def union_panels(frames: Sequence[DataFrame]) -> DataFrame:
    """All panels under each other, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def aligned(df: DataFrame, template: DataFrame) -> DataFrame:
    """Take over the names of a template frame by position."""
    return df.toDF(*template.columns)


def one_row_per_entity(panel: DataFrame, keys: Sequence[str], hour: str, seed: int | str) -> DataFrame:
    """One of the hours each entity really has, drawn from the seed and the entity alone."""
    draw = hash_text(seed, *[F.col(k) for k in keys], F.col(hour))
    return first_row_per_key(panel.withColumn("_draw", draw), keys, ["_draw", hour]).drop("_draw")
