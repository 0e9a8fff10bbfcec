"""Split, impute, encode and guard queries on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import fill_not_measured
from ..functions.text import null_tokens
from ..operators.guard import Limits, observed_write
from ..operators.levels import LevelTable
from ..operators.prep import (
    binary_label, bucket_new_levels, check_columns, check_missing, fit_common_levels, fit_levels, fit_modes, impute_modes,
    modes, one_hot as add_indicators, ordered_like, pool_rare, schema_report,
)
from ..operators.split import half_split as build_half_split, stratified_folds, stratified_split as build_split, rest_rows as build_rest, test_rows as build_test, train_rows as build_train
from ..operators.panel import aligned, union_panels
from ..sources.readers import renamed
from .registry import query
from .star import scored, table

SEED = 124800


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return build_split(scored(spark, sf).select("encounter_id", "label"), "encounter_id", "label", SEED, 0.7)


@query
def stratified_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(scored(spark, sf).select("encounter_id", "label"), "encounter_id", "label", 1234, 5)


@query
def half_split(spark: SparkSession, sf: str) -> DataFrame:
    return build_half_split(table(spark, sf, "orders").select(F.col("o_orderkey").alias("encounter_id")), "encounter_id", 7)[0]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_linenumber", "l_quantity")


@query
def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return build_train(lines(spark, sf), stratified_split(spark, sf), "encounter_id")


@query
def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return build_test(lines(spark, sf), stratified_split(spark, sf), "encounter_id")


test_rows.__test__ = False


@query
def rest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the visits that are not in the first half."""
    first = half_split(spark, sf).withColumn("is_train", F.lit(True))
    return build_rest(lines(spark, sf), first, "encounter_id")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("n"), (F.col("c_nationkey") % 7).cast("string")).alias("area"))
    return null_tokens(c, ["MACHINERY"], ["c_mktsegment"])


@query
def column_modes(spark: SparkSession, sf: str) -> DataFrame:
    return modes(customers(spark, sf), ["c_mktsegment", "area"])


@query
def mode_impute(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    train = c.filter(F.col("c_custkey") % 10 < 7)
    return impute_modes(c, fit_modes(train, ["c_mktsegment", "area"]))


@query
def rare_pool(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return pool_rare(parts, "p_brand", fit_common_levels(parts, "p_brand", 0.04))


@query
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators learned on the customers outside one area; its level is new when they are applied."""
    c = impute_modes(customers(spark, sf), {"c_mktsegment": "BUILDING"})
    levels = fit_levels(c.filter(F.col("area") != "n6"), ["c_mktsegment", "area"])
    return add_indicators(bucket_new_levels(c, levels), levels)


@query
def schema_guard(spark: SparkSession, sf: str) -> DataFrame:
    needed = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    rows = check_missing(check_columns(table(spark, sf, "orders"), needed), needed)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"), F.round(F.max("o_totalprice"), 2).alias("top_price"))


@query
def sparse_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a design matrix with a level per order, more than would be brought to the driver, and a hot category."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_quantity", F.col("l_orderkey").cast("string").alias("order_level"), "l_returnflag", "l_linenumber")
    train = rows.filter("l_linenumber <= 3 and l_returnflag <> 'A'")
    found = LevelTable(train, ["l_quantity"], ["order_level", "l_returnflag"], hot_rows=1_000).matrix(rows, ["row_id"])
    return found.select("row_id", "size", F.explode(F.arrays_zip("slots", "values")).alias("e")).select("row_id", "size", "e.slots", "e.values").withColumnsRenamed({"slots": "slot", "values": "value"})


@query
def observed_load(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of orders joined with their customers' segments, gathered while the joined rows are written."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderdate")
    segments = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").filter("c_custkey % 3 > 0")
    limits = Limits(least_rows=1, most_missing={"status": 0.5}, checks={"key": F.col("o_orderkey") >= 0})
    return observed_write(orders, limits, columns=["c_mktsegment"], ranges=["o_orderkey"], join=(segments, ["c_custkey"])).table()


@query
def schema_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of two tables that should be alike: where they are, and whether type and place agree."""
    first = renamed(table(spark, sf, "customer"), {"c_custkey": "key", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance"})
    second = renamed(table(spark, sf, "supplier"), {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"})
    return schema_report(first, second)


@query
def renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the names and in the order of a template, under customers."""
    names = {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"}
    second = renamed(table(spark, sf, "supplier"), names).select("nation", "name", "key")
    first = aligned(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), second.select("key", "name", "nation"))
    return union_panels([first, ordered_like(second, first)])


@query
def label_words(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("encounter_id", binary_label(F.col("label")).alias("outcome_yn"))


@query
def not_measured_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") == "click", F.col("value")).alias("click_value"))
    return fill_not_measured(null_tokens(e, ["view"], ["event_type"]))
