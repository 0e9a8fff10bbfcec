"""Look-back features over an entity's own earlier visits.

The obvious form joins every index visit to every earlier visit of the same
entity, which is quadratic in the visits of an entity. Here both kinds of visit
are put on one timeline per entity and read with running aggregates, so no pair
of visits is ever built. Three marks are laid on the timeline:

* an end mark at the end of every earlier visit,
* an expiry mark when that visit leaves the counting period,
* an index mark at the start of every index visit.

At one instant the order is expiry, index, end. That keeps "ended strictly
before" strict, and "at most `days` whole days ago" exact to the microsecond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_once
from .running import running_segments, running_window, segment_edges, with_segment
from .skew import HOT_ROWS, hot_keys, split_by_heat

EXPIRY, INDEX, END = 0, 1, 2


def history_features(
    index: DataFrame,
    prior: DataFrame,
    *,
    keys: Sequence[str],
    index_id: str,
    index_ts: str,
    prior_id: str,
    prior_ts: str,
    count_as: str = "n_past_year",
    days: int = 365,
    since: Mapping[str, str] | None = None,
    ever: Mapping[str, str] | None = None,
    latest: Mapping[str, tuple[str, str]] | None = None,
    size_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per index visit that has at least one earlier visit of the same entity.

    `keys` identify the entity; it must be the same entity on both sides, so an
    entity known to two facilities is two entities when the facility is a key.

    * `count_as`: visits that ended at most `days` whole days ago.
    * `since[out] = flag`: whole days since the last visit whose flag is 1, null if never.
    * `ever[out] = flag`: 1 if any earlier visit has flag 1, else 0.
    * `latest[out] = (flag, value)`: value on the most recent visit whose flag is 1. A null
      value on that visit stays null; visits that end together are ordered by `prior_id`.

    An entity with more than `hot_rows` marks is read in time segments. `size_from` is
    a table with the keys and one row per visit that is cheaper to count than `prior`.
    """
    keys, since, ever, latest = list(keys), dict(since or {}), dict(ever or {}), dict(latest or {})
    marks = _timeline(index, prior, keys, index_id, index_ts, prior_id, prior_ts, days, since, ever, latest)
    sums = ["_in_period", "_ended"]
    maxes = [f"_{out}" for out in [*since, *ever, *latest]]
    outputs = _outputs(count_as, since, ever, latest)

    # A visit leaves three marks at most.
    hot = hot_keys(marks, keys, hot_rows) if size_from is None else hot_keys(size_from, keys, hot_rows // 3)
    plain = marks if hot is None else split_by_heat(marks, keys, hot)[0]
    features = _at_index(running_window(plain, keys, ["_ts", "_kind"], sums, maxes)).select(index_id, *outputs)
    if hot is None:
        return features

    # Hot entities: first one row per instant, then running segments over time.
    busy = split_by_heat(marks, keys, hot)[1]
    instants = busy.groupBy(*keys, "_ts", "_kind").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]
    )
    # Written down once: the edges, the segment totals and the rows all read it.
    instants = written_once(instants.withColumn("_position", F.unix_micros("_ts")))
    n_rows = instants.count()
    cut = with_segment(instants, "_position", segment_edges(instants, "_position", max(2, n_rows // hot_rows + 1)))
    at_instant = _at_index(running_segments(cut, keys, ["_ts", "_kind"], sums, maxes)).select(*keys, "_ts", *outputs)
    visits = busy.filter(F.col("_kind") == INDEX).select(*keys, "_ts", index_id)
    return features.unionByName(visits.join(at_instant, [*keys, "_ts"]).select(index_id, *[n for n in at_instant.columns if n not in {*keys, "_ts"}]))


def visits_in_period(
    index: DataFrame,
    prior: DataFrame,
    *,
    keys: Sequence[str],
    index_id: str,
    index_ts: str,
    prior_id: str,
    prior_ts: str,
    days: int = 365,
    out: str = "n_past_year",
    size_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Only the count of `history_features`, and only the index visits where it is above zero."""
    counted = history_features(
        index, prior, keys=keys, index_id=index_id, index_ts=index_ts, prior_id=prior_id, prior_ts=prior_ts,
        count_as=out, days=days, size_from=size_from, hot_rows=hot_rows,
    )
    return counted.filter(F.col(out) > 0)


def _timeline(index, prior, keys, index_id, index_ts, prior_id, prior_ts, days, since, ever, latest) -> DataFrame:
    id_type = index.schema[index_id].dataType
    prior = prior.filter(F.col(prior_ts).isNotNull()).dropna(subset=keys)
    ts = F.col(prior_ts).cast("timestamp")

    def flagged(flag: str, value: Column) -> Column:
        return F.when(F.col(flag) == 1, value)

    facts = {f"_{out}": flagged(flag, ts) for out, flag in since.items()}
    facts |= {f"_{out}": F.when(F.col(flag) == 1, 1).otherwise(0) for out, flag in ever.items()}
    facts |= {
        f"_{out}": flagged(flag, F.struct(ts.alias("ts"), F.col(prior_id).alias("id"), F.col(value).alias("value")))
        for out, (flag, value) in latest.items()
    }
    # `days` whole days have passed for the last time just before day `days + 1` is complete.
    leaves = ts + F.make_dt_interval(days=F.lit(days + 1))

    def mark(at: Column, kind: int, in_period: int, ended: int, values: Mapping[str, Column]) -> list[Column]:
        return [
            at.alias("_ts"), F.lit(kind).alias("_kind"), F.lit(in_period).cast("long").alias("_in_period"),
            F.lit(ended).cast("long").alias("_ended"), *[v.alias(n) for n, v in values.items()],
        ]

    # Both marks of a visit come from one pass over `prior`.
    blank = {name: F.when(F.lit(False), value) for name, value in facts.items()}
    both = F.array(F.struct(*mark(ts, END, 1, 1, facts)), F.struct(*mark(leaves, EXPIRY, -1, 0, blank)))
    ends = prior.select(*keys, F.lit(None).cast(id_type).alias(index_id), F.inline(both))
    nothing = {name: F.lit(None).cast(ends.schema[name].dataType) for name in facts}
    starts = index.filter(F.col(index_ts).isNotNull()).dropna(subset=keys).select(
        *keys, index_id, *mark(F.col(index_ts).cast("timestamp"), INDEX, 0, 0, nothing)
    )
    return ends.unionByName(starts)


def _at_index(marks: DataFrame) -> DataFrame:
    return marks.filter((F.col("_kind") == INDEX) & (F.col("_ended") > 0))


def _outputs(count_as, since, ever, latest) -> list[Column]:
    return [
        F.col("_in_period").alias(count_as),
        *[F.timestamp_diff("DAY", F.col(f"_{out}"), F.col("_ts")).alias(out) for out in since],
        *[F.coalesce(F.col(f"_{out}"), F.lit(0)).alias(out) for out in ever],
        *[F.col(f"_{out}")["value"].alias(out) for out in latest],
    ]
