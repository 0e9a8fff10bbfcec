"""Panels as streams: calendar hours of one measure, and the snapshot panel, hours after an anchor with many measures.

The snapshot stream keeps no state: every batch leaves what its events add to the panel, in a folder of its own, and the panel
is read from all of them. Late events need no rule, a batch that runs again replaces its own folder, and `compact_parts` puts
many small folders into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.model import score
from ..operators.panel import SNAPSHOT_HOURS, panel_of_parts, snapshot_parts


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files under a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_panel(events: DataFrame, keys: Sequence[str], *, ts: str, tie: str, value: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Per key and window: rows, first, last, lowest, highest and mean value.

    State is one small row per open window; it goes once the watermark has passed.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_ts").alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("v")))
    grouped = timed.groupBy(*keys, F.window("_ts", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(point).alias("_a"), F.max(point).alias("_z"),
        F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.avg(value).alias("value_mean"),
    )
    return grouped.select(
        *keys, F.col("_w.start").alias("window_start"), "n_events", F.col("_a.v").alias("value_first"), F.col("_z.v").alias("value_last"),
        "value_min", "value_max", "value_mean",
    )


def run_panel(panel: DataFrame, out: str, checkpoint: str, model: PipelineModel | None = None, available_now: bool = True):
    """Write the changed rows of every batch to `out/batch=<n>`, scored if a model is given.

    A batch that is run again replaces its own folder, so every batch counts once.
    Both folders must be shared storage on a cluster.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if model is None else score(model, batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = panel.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every (key, window) written so far."""
    newest = Window.partitionBy(*keys, "window_start").orderBy(F.desc("batch"))
    rows = spark.read.parquet(out).withColumn("_n", F.row_number().over(newest))
    return rows.filter("_n = 1").drop("_n", "batch")


def run_snapshot(
    events: DataFrame, anchors: DataFrame, keys: Sequence[str], *, ts: str, anchor: str, tie: str, measures: Mapping[str, Column], out: str, checkpoint: str,
    hours: Sequence[int] = SNAPSHOT_HOURS, available_now: bool = True,
):
    """Write what each batch of `events` adds to the snapshot panel to `out/batch=<n>`. `anchors` is a table with one row per key."""

    def write(batch: DataFrame, number: int) -> None:
        parts = snapshot_parts(batch, anchors, keys, ts=ts, anchor=anchor, tie=tie, measures=measures, hours=hours)
        parts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def snapshot_rows(spark: SparkSession, out: str, keys: Sequence[str], measures: Sequence[str], hours: Sequence[int] = SNAPSHOT_HOURS, model: PipelineModel | None = None) -> DataFrame:
    """The panel of all batches so far, with the columns of the batch panel; scored if a model is given."""
    rows = panel_of_parts(spark.read.parquet(out).drop("batch"), keys, measures, hours)
    return rows if model is None else score(model, rows)


def compact_parts(spark: SparkSession, out: str, target: str, keys: Sequence[str], measures: Sequence[str]) -> None:
    """All parts under `out` as one row per entity and hour under `target`, as batch -1; run while no batch is being written."""
    p = spark.read.parquet(out).drop("batch")
    merged = [F.sum("_n").alias("_n")]
    for n in measures:
        merged += [
            F.min_by(f"_first_{n}", f"_begin_{n}").alias(f"_first_{n}"), F.min(f"_begin_{n}").alias(f"_begin_{n}"), F.max_by(f"_last_{n}", f"_end_{n}").alias(f"_last_{n}"),
            F.max(f"_end_{n}").alias(f"_end_{n}"), F.min(f"_min_{n}").alias(f"_min_{n}"), F.max(f"_max_{n}").alias(f"_max_{n}"),
            F.sum(f"_sum_{n}").alias(f"_sum_{n}"), F.sum(f"_n_{n}").alias(f"_n_{n}"),
        ]
    p.groupBy(*keys, "_hour").agg(*merged).select(*p.columns).write.mode("overwrite").parquet(f"{target}/batch=-1")
