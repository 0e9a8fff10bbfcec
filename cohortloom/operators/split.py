"""Reproducible splits: every draw is a function of the seed and the key.

Exact shares need a rank over each whole class. Ranking by md5 lets the work be
cut by the first hex digits of the hash: a bin is a small window, and the bins
before it add a constant. No window ever sees a whole class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import hash_number, hash_text
from ..session import written_once

BIN_ROWS = 100_000
MOST_BROADCAST = 500_000


def bin_digits(n_rows: int) -> int:
    """Hex digits of the hash that cut a class into bins of at most about BIN_ROWS rows."""
    digits = 3
    while n_rows > BIN_ROWS * 16**digits:
        digits += 1
    return digits


def _sent(table: DataFrame) -> DataFrame:
    """A stored table to every task if it is small; beyond that Spark's choice."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _bins(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per class and bin: rows, rows in the bins before, rows in the class."""
    whole = Window.partitionBy(*names)
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*names, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_size": F.sum("_n").over(whole)})


def hash_rank(df: DataFrame, key: str, strata: Sequence[str], seed: int | str, out: str = "rank", size: str = "stratum_size", digits: int | None = None) -> DataFrame:
    """Add the rank 1..n of every row inside its class in hash order, and n. `key` is unique."""
    strata = list(strata)
    digits = digits or bin_digits(df.count())
    marked = df.withColumn("_hash", hash_text(seed, F.col(key))).withColumn("_bin", F.substring("_hash", 1, digits))
    offsets = written_once(_bins(marked.select(*strata, "_bin"), strata).select(
        *[F.col(c).alias(f"_o_{c}") for c in [*strata, "_bin"]], "_before", F.col("_size").alias(size)
    ))
    on = F.col("_bin") == F.col("_o__bin")
    for c in strata:
        on &= F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_bin").orderBy("_hash", key))
    ranked = marked.withColumn("_inside", inside).join(_sent(offsets), on)
    return ranked.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out), size)


def cut_points(entities: DataFrame, key: str, outcome: str, seed: int | str, share: float, digits: int | None = None) -> DataFrame:
    """Per class the last entity inside the share: _class, _cut_hash, _cut_key; classes without one have no row.

    Bin counts tell in which bin of a class the cut falls; only that bin is ranked.
    """
    marked = entities.select(F.col(outcome).alias("_class"), F.col(key).alias("_key"), hash_text(seed, F.col(key)).alias("_hash"))
    marked = written_once(marked)
    marked = marked.withColumn("_bin", F.substring("_hash", 1, digits or bin_digits(marked.count())))
    place = F.ceil(F.round(F.col("_size") * F.lit(share), 6)) - F.col("_before")
    cut = _bins(marked.select("_class", "_bin"), ["_class"]).withColumn("_place", place).filter((F.col("_place") > 0) & (F.col("_place") <= F.col("_n")))
    cut = written_once(cut.select(F.col("_class").alias("_c"), F.col("_bin").alias("_b"), "_place"))  # one bin per class
    here = marked.join(_sent(cut), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_b")))
    row = F.row_number().over(Window.partitionBy("_class", "_bin").orderBy("_hash", "_key"))
    last = here.withColumn("_row", row).filter("_row = _place")
    return written_once(last.select("_class", F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key")))


def stratified_split(entities: DataFrame, key: str, outcome: str, seed: int | str, share: float = 0.7, digits: int | None = None) -> DataFrame:
    """Add `is_train`: in each outcome class the first ceil(share x n) entities in hash order.

    The cut points are found first, from a stored table of keys and outcomes; with them the flag needs no shuffle of the
    entities while the classes are few. Entities added later fall on the same side.
    """
    points = _sent(cut_points(entities, key, outcome, seed, share, digits))
    digest = hash_text(seed, F.col(key))
    inside = (digest < F.col("_cut_hash")) | ((digest == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key")))
    marked = entities.join(points, F.col(outcome).eqNullSafe(F.col("_class")), "left")
    return marked.select(*entities.columns, F.coalesce(inside, F.lit(False)).alias("is_train"))


def stratified_folds(entities: DataFrame, key: str, outcome: str, seed: int | str, folds: int = 5) -> DataFrame:
    """Add `fold` 0..folds-1; in each class fold sizes differ by at most one."""
    ranked = hash_rank(entities, key, [outcome], seed, "_rank", "_size")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank", "_size")


def half_split(df: DataFrame, key: str, seed: int | str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A random part of the rows and the rest, without a shuffle."""
    low = hash_number(seed, F.col(key)) < F.lit(int(share * 2**32))
    return df.filter(low), df.filter(~low)


def train_rows(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """All rows of the training entities."""
    return df.join(split.filter("is_train").select(key), key, "left_semi")


def test_rows(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """All rows of the entities in the test part; entities that were never split are in neither."""
    return df.join(split.filter("not is_train").select(key), key, "left_semi")


def rest_rows(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """All rows of entities that are not in the training part."""
    return df.join(split.filter("is_train").select(key), key, "left_anti")


test_rows.__test__ = False
