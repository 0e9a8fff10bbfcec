"""Summary tables on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import NOT_MEASURED, POUNDS_PER_KG, left_closed_bin, measured, row_sum
from ..functions.text import null_tokens
from ..functions.time import age_years
from ..operators.codes import code_pivot, with_flags
from ..operators.profile import numeric_profile as build_numeric_profile
from ..operators.summary import any_missing, frequencies as build_frequencies, group_totals, load_report as build_load_report, most_common, profile as build_profile, rate_by
from .cohort_queries import CODES, birth_day, diagnoses
from .registry import query
from .star import scored, table, visits


@query
def rate_by_age_band(spark: SparkSession, sf: str) -> DataFrame:
    age = age_years(F.col("admit_ts"), birth_day(F.col("patient_id")))
    rows = visits(spark, sf).select("encounter_id", left_closed_bin(age, 0, 110, 10).alias("age_band"))
    rates = rate_by(rows.join(scored(spark, sf).select("encounter_id", "label"), "encounter_id"), ["age_band"], "label")
    return rates.select("age_band", "n", *[F.round(c, 9).alias(c) for c in ("rate", "lower", "upper")])


@query
def rate_by_weight_band(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome rate in bands of a converted amount, rows marked as not measured left out."""
    amount = F.when(F.col("stay") == 0, F.lit(float(NOT_MEASURED))).otherwise(F.col("amount") / 1000)
    rows = visits(spark, sf).select("encounter_id", amount.alias("kg")).filter(measured(F.col("kg")))
    banded = rows.withColumn("band", left_closed_bin(F.col("kg") * POUNDS_PER_KG, 0, 1200, 100))
    rates = rate_by(banded.join(scored(spark, sf).select("encounter_id", "label"), "encounter_id"), ["band"], "label")
    return rates.select("band", "n", F.round("rate", 9).alias("rate"))


def clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    return null_tokens(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"), ["4-NOT SPECIFIED"], ["o_orderpriority"])


@query
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return build_profile(clean_orders(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query
def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    out = build_frequencies(clean_orders(spark, sf), ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("proportion", F.round("proportion", 9))


@query
def missing_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return any_missing(clean_orders(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query
def indicator_row_sum(spark: SparkSession, sf: str) -> DataFrame:
    flags = with_flags(visits(spark, sf).select("encounter_id"), code_pivot(diagnoses(spark, sf), ["encounter_id"], "code", CODES), ["encounter_id"], list(CODES))
    return flags.select("encounter_id", row_sum(*CODES).alias("n_codes"))


@query
def group_having_topk(spark: SparkSession, sf: str) -> DataFrame:
    words = [F.lower("p_name").alias("name"), F.lower("p_type").alias("kind")]
    return most_common(table(spark, sf, "part"), words, F.col("name").like("%ring%"), 20)


@query
def group_sum_desc(spark: SparkSession, sf: str) -> DataFrame:
    totals = group_totals(table(spark, sf, "orders"), [F.col("o_orderpriority").alias("category")], F.round(F.col("o_totalprice") * 100).cast("long"), "cents")
    return totals


@query
def distinct_visits(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct rows, and the distinct values of one column."""
    return visits(spark, sf).select("patient_id", "priority").distinct()


@query
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return visits(spark, sf).agg(F.count_distinct("patient_id").alias("n_patients"), F.count_distinct("admit_ts").alias("n_times"))


@query
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return build_load_report({n: table(spark, sf, n) for n in ("orders", "lineitem", "customer", "events")})


def value_profile(spark: SparkSession, sf: str, **more) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    found = build_numeric_profile(lines, ["l_quantity", "l_extendedprice", "l_tax"], **more)
    ends = [F.col(name)[k].alias(f"{name}{k + 1}") for name in ("lowest", "highest") for k in range(5)]
    rounded = [F.round(c, 6).alias(c) for c in found.columns if c in ("info", "mean", "gmd") or c.startswith("q")]
    return found.select("column", "n", "missing", "distinct", *rounded, *ends)


@query
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    return value_profile(spark, sf)


@query
def numeric_profile_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with the running counts made in segments of the value range."""
    return value_profile(spark, sf, segment_rows=1_000)
