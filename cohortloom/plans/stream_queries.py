"""The streaming panel, run to the end of the given files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from ..streaming.panel import event_stream, hourly_panel, latest_rows, run_panel, run_snapshot, snapshot_rows
from .registry import query
from .star import table
from .time_queries import MEASURES, first_seen


@query
def stream_hourly_panel(spark: SparkSession, sf: str) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    events = event_stream(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)
    folder = f"{ensure_checkpoint_dir(spark)}/hourly-panel-{uuid.uuid4().hex}"
    panel = hourly_panel(events, ["user_id"], ts="ts", tie="event_id", value="value", late="40 days")
    run_panel(panel, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return latest_rows(spark, f"{folder}/rows", ["user_id"]).withColumn("value_mean", F.round("value_mean", 6))


@query
def stream_snapshot_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot panel, from a stream of the events."""
    events = event_stream(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema)
    folder = f"{ensure_checkpoint_dir(spark)}/snapshot-panel-{uuid.uuid4().hex}"
    run_snapshot(
        events, first_seen(spark, sf), ["user_id"], ts="ts", anchor="first_ts", tie="event_id", measures={n: make() for n, make in MEASURES.items()},
        out=f"{folder}/rows", checkpoint=f"{folder}/state",
    ).awaitTermination()
    rows = snapshot_rows(spark, f"{folder}/rows", ["user_id"], list(MEASURES))
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.endswith(("_mean", "_change"))})
