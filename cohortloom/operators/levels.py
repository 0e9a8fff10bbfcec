"""A dictionary of category levels as a table, and sparse design matrices made with it. No level comes to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written_once
from .skew import HOT_ROWS, salted_join


def ranked(df: DataFrame, by: str, order: str) -> DataFrame:
    """Adds `rank` (from 0) by `order` among the rows of one `by`, none of which is sorted in one task: rows are dealt by range and
    numbered where they lie, and only the counts per (group, task) are added up."""
    lain = df.repartitionByRange(by, order).sortWithinPartitions(by, order)
    lain = written_once(lain.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    spans = lain.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    moves = spans.select("_by", "_p", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_move"))
    joined = lain.join(moves, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_id") + F.col("_move")).alias("rank"))


def _long(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key, column (its number), level; without nulls."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).cast("string").alias("level")) for k, c in enumerate(columns)]))
    return df.select(*key, each.alias("_c")).select(*key, "_c.*").filter("level is not null")


class LevelTable:
    """Levels of `categories`, learned on some rows: `table` has column (number), level, slot. The slots of `numeric` come first, then
    those of each category's levels in ascending order, each category's followed by one for levels that were not seen or are missing."""

    def __init__(self, train: DataFrame, numeric: Sequence[str], categories: Sequence[str], hot_rows: int = HOT_ROWS):
        self.numeric, self.categories, self.hot_rows = list(numeric), list(categories), hot_rows
        levels = written_once(ranked(_long(train, [], categories).distinct(), "column", "level"))
        counts = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
        self.first, slot = [], len(self.numeric)
        for k in range(len(self.categories)):
            self.first.append(slot)
            slot += counts.get(k, 0) + 1
        self.size = slot
        self.new = [end - 1 for end in [*self.first[1:], slot]]
        start = F.element_at(F.array(*[F.lit(x).cast("long") for x in self.first]), F.col("column") + 1)
        self.table = levels.select("column", "level", (start + F.col("rank")).alias("slot"))

    def entries(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """key, slot, value of all entries that are not 0: numeric values (missing ones as NaN) and a 1 per category.

        Rows of one level may be any share of all: they are spread over tasks.
        """
        key = list(key)
        values = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("slot"), F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias("value")) for k, c in enumerate(self.numeric)]))
        numbers = df.select(*key, values.alias("_v")).select(*key, "_v.*").filter("value <> 0") if self.numeric else None
        if not self.categories:
            return numbers
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("level")) for k, c in enumerate(self.categories)]))
        long = df.select(*key, each.alias("_c")).select(*key, "_c.*")
        known = self.table.select("column", F.concat(F.lit("="), "level").alias("level"), "slot")
        found = salted_join(long, known, ["column", "level"], spread_on=key, how="left", min_rows=self.hot_rows)
        unseen = F.element_at(F.array(*[F.lit(x).cast("long") for x in self.new]), F.col("column") + 1)
        ones = found.select(*key, F.coalesce("slot", unseen).alias("slot"), F.lit(1.0).alias("value"))
        return ones if numbers is None else numbers.unionByName(ones)

    def matrix(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """key, size, slots (ascending) and values: a sparse row per key, as wide as the row has columns."""
        rows = self.entries(df, key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("_e"))
        return rows.select(*key, F.lit(self.size).cast("long").alias("size"), F.col("_e.slot").alias("slots"), F.col("_e.value").alias("values"))

    def names(self) -> DataFrame:
        """slot, column, level of every slot; level is null for numbers and for the slots of what was not seen."""
        spark, every = self.table.sparkSession, [*self.numeric, *self.categories]
        own = [(k, c, None) for k, c in enumerate(self.numeric)] + [(s, c, None) for s, c in zip(self.new, self.categories)]
        label = F.element_at(F.array(*[F.lit(c) for c in every[len(self.numeric):]] or [F.lit("")]), F.col("column") + 1)
        return spark.createDataFrame(own, "slot long, column string, level string").unionByName(self.table.select("slot", label.alias("column"), "level"))
