"""Lookups: code to category tables and joins that must not add rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .dedupe import first_row_per_key


def lookup_first(df: DataFrame, mapping: DataFrame, *, on: str, key: str, take: Mapping[str, str], order: Sequence[str | Column]) -> DataFrame:
    """Left join to the first mapping row of each key; `take = {new name: mapping column}`.

    The mapping has no size promise, so Spark picks the join from its statistics: a small
    one is broadcast, and beside a big one adaptive execution splits the rows of a hot code.
    """
    first = first_row_per_key(mapping.filter(F.col(key).isNotNull()), [key], order)
    right = first.select(F.col(key).alias(on), *[F.col(c).alias(n) for n, c in take.items()])
    return df.join(right, on, "left")


def grouped_category(df: DataFrame, mapping: DataFrame, *, on: str, key: str, base: str, override: str, out: str, order, fallback: str = "other") -> DataFrame:
    """Category of a code: the mapping's override if it has one, else its lower-cased base; `fallback` for unmapped codes.

    A missing code stays missing.
    """
    named = mapping.withColumn("_category", F.coalesce(F.col(override), F.lower(F.col(base))))
    joined = lookup_first(df, named, on=on, key=key, take={out: "_category"}, order=order)
    return joined.withColumn(out, F.when(F.col(on).isNotNull(), F.coalesce(F.col(out), F.lit(fallback))))


def add_columns(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join only the columns that `left` does not have yet. `right` must hold one row per key."""
    on = list(on)
    return left.join(right.select(*on, *[c for c in right.columns if c not in left.columns]), on, how)


def rows_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys have 1, 2, 3, ... rows: the fan-out check after a merge."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_per_key"))
    return per_key.groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("n_keys"))
