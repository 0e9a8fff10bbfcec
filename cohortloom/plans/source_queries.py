"""Writers and readers on the star-schema tables: written to shared storage, read back with options."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import ensure_checkpoint_dir
from ..sources.readers import read_delimited, read_text_columns
from ..sources.writers import read_extract, read_panel, write_extract, write_panel
from .registry import query
from .star import table, visits
from .time_queries import panel


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def delimited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pipe-separated text with upper-case names and null strings, read back typed."""
    path = folder(spark, "orders-text")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ENCOUNTERID"), F.col("o_orderpriority").alias("PRIORITY"),
        F.when(F.col("o_orderstatus") == "P", "NULL").otherwise(F.col("o_orderstatus")).alias("STATUS"), F.col("o_totalprice").alias("AMOUNT"),
    )
    rows.write.csv(path, sep="|", header=True)
    schema = T.StructType([
        T.StructField("amount", T.DoubleType()), T.StructField("encounterid", T.LongType()), T.StructField("priority", T.StringType()),
        T.StructField("status", T.StringType()),
    ])
    return read_delimited(spark, path, schema, sep="|", drop=["priority"])


@query
def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A comma-separated file with defaults: all columns as text."""
    path = folder(spark, "part-text")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.csv(path, header=True)
    return read_text_columns(spark, path)


@query
def panel_hours_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The panel written by hour, and two of its hours read back."""
    path = folder(spark, "panel")
    write_panel(panel(spark, sf).select("user_id", "hour", "n_events", "reading_max"), path)
    return read_panel(spark, path, [1, 6])


@query
def extract_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Two date ranges of visits written side by side; one is read back."""
    path, v = folder(spark, "visits"), visits(spark, sf).select("encounter_id", "admit_ts")
    for first, last, after in (("1996-01-01", "1996-12-31", "1997-01-01"), ("1997-01-01", "1997-12-31", "1998-01-01")):
        write_extract(v.filter((F.col("admit_ts") >= F.lit(first)) & (F.col("admit_ts") < F.lit(after))), path, first, last)
    return read_extract(spark, path, first_day="1997-01-01").select("encounter_id", "admit_ts")
