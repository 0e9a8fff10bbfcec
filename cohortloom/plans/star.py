"""The star-schema test tables seen as visits, events, codes and scores.

One order is one visit of a customer. Everything here is a lazy projection of
the whole table; nothing is sampled or limited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Declared, so that no file footer has to be read before a query is planned.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encounter_id, patient_id, admit_ts, discharge_ts, stay, three 0/1 kinds, priority, amount."""
    stay = F.pmod(F.col("o_orderkey"), F.lit(14)).cast("int")
    start = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_custkey").alias("patient_id"),
        start.alias("admit_ts"),
        (start + F.make_dt_interval(days=stay)).alias("discharge_ts"),
        stay.alias("stay"),
        *[(F.col("o_orderstatus") == s).cast("int").alias(n) for n, s in [("ed", "F"), ("ip", "O"), ("icu", "P")]],
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encounter_id, hour, score in [0, 1], label: a deterministic score per visit.

    The label is 1 when a visit has a line that was returned and finished.
    """
    hit = (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .groupBy(F.col("l_orderkey").alias("encounter_id"))
        .agg(F.lit(1).alias("label"))
    )
    rows = visits(spark, sf_dir).select(
        "encounter_id",
        F.element_at(F.array(*[F.lit(h) for h in (1, 3, 6, 12, 24)]), (F.col("encounter_id") % 5 + 1).cast("int")).alias("hour"),
        # Whole cents first, so that no rounding of a half is involved.
        (F.expr("cast(round(amount * 100) as bigint) div 5000") / 10000).alias("score"),
    )
    return rows.join(hit, "encounter_id", "left").fillna({"label": 0})
