"""Keys that hold far more rows than one task should sort.

`hot_keys` finds them with one map-side combined count and stores them with their counts. There can be at most one for each
`min_rows` rows of the table; up to MOST_BROADCAST they are sent to every task, beyond that Spark joins them as it likes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_once

HOT_ROWS = 5_000_000
MOST_BROADCAST = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame | None:
    """All keys with more than `min_rows` rows, with their number as `_rows`, or None if there are none."""
    counts = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = written_once(counts.filter(F.col("_rows") > min_rows))
    return hot if hot.take(1) else None


def _sent(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot


def split_by_heat(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys). `hot` comes from `hot_keys`."""
    keys = list(keys)
    few = _sent(hot.select(*keys))
    return df.join(few, keys, "left_anti"), df.join(few, keys, "left_semi")


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    *,
    spread_on: Sequence[str],
    condition: Column | None = None,
    how: str = "inner",
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join on `keys` where `many` may be skewed: rows of a hot key are spread over one task for each `min_rows` of them.

    Only the hot keys' rows of `one` are repeated, so nothing grows for ordinary
    keys. `spread_on` names columns of `many` that differ between its rows.
    The extra `condition` refers to plain column names of either side.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, min_rows)
    if hot is None:
        joined = many.join(one, keys, how)
        return joined if condition is None else joined.filter(condition)
    mark = _sent(hot.select(*keys, F.ceil(F.col("_rows") / min_rows).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(mark, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_on), salts)).drop("_salts")
    right = one.join(mark, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    joined = left.join(right, keys + ["_salt"], how).drop("_salt")
    return joined if condition is None else joined.filter(condition)
