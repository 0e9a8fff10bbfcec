"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order; give a unique tie-break as the last item.

    Plain names sort ascending with nulls last. Spark keeps only the first row
    per key of every map task before the shuffle, so a hot key stays small.
    """
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def earliest_event(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    keep: dict[str, str],
) -> DataFrame:
    """First event with a known time per key, as `keep = {new name: column}`; join it to entities with `left`."""
    known = events.filter(F.col(ts).isNotNull())
    return first_row_per_key(known, keys, [ts, *tie]).select(*keys, *[F.col(c).alias(n) for n, c in keep.items()])
