from __future__ import annotations

from datetime import datetime, timedelta

from conftest import rows
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from pyspark.sql import functions as F

from cohortloom.operators.panel import snapshot_panel
from cohortloom.streaming.panel import compact_parts, event_stream, hourly_panel, latest_rows, run_panel, run_snapshot, snapshot_rows

T0 = datetime(2024, 1, 1)
SCHEMA = "user long, id long, ts timestamp, v double"


def run(spark, folder, out, state, model=None, late="2 hours"):
    events = event_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    panel = hourly_panel(events, ["user"], ts="ts", tie="id", value="v", late=late)
    run_panel(panel, str(out), str(state), model).awaitTermination(120)
    return latest_rows(spark, str(out), ["user"])


def write(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_windows_are_updated_across_runs_and_late_rows_stay_out(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    minutes = lambda n: T0 + timedelta(minutes=n)
    write(spark, folder, [(1, 1, minutes(5), 2.0), (1, 2, minutes(50), None), (2, 3, minutes(10), 7.0)])
    first = run(spark, folder, out, state)
    assert rows(first.select("user", "n_events", "value_first", "value_last"), "user") == [(1, 2, 2.0, 2.0), (2, 1, 7.0, 7.0)]
    write(spark, folder, [(1, 4, minutes(55), 9.0), (1, 5, minutes(600), 1.0)])
    second = run(spark, folder, out, state)
    assert rows(second.select("user", "window_start", "n_events", "value_first", "value_last", "value_mean"), "user", "window_start") == [
        (1, T0, 3, 2.0, 9.0, 5.5), (1, T0 + timedelta(hours=10), 1, 1.0, 1.0, 1.0), (2, T0, 1, 7.0, 7.0, 7.0),
    ]
    # The watermark is now at 8 h, so a row of the first hour is too late.
    write(spark, folder, [(1, 6, minutes(56), 100.0)])
    assert run(spark, folder, out, state).filter("user = 1 and n_events = 4").count() == 0


def test_batches_are_scored(spark, tmp_path):
    columns = ["n_events", "value_mean"]
    train = spark.createDataFrame([(i % 5 + 1, float(i), float(i > 10)) for i in range(20)], "n_events long, value_mean double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTClassifier(maxIter=1, maxDepth=1)]).fit(train)
    write(spark, tmp_path / "in", [(1, 1, T0, 2.0), (2, 2, T0, 19.0)])
    got = dict(rows(run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", model).select("user", "score")))
    assert got[1] < 0.5 < got[2]


def test_snapshot_stream_equals_the_batch_panel(spark, tmp_path):
    data = [(u, 10 * u + k, T0 + timedelta(minutes=37 * k + u), float((7 * k + u) % 5) if k % 4 else None) for u in range(3) for k in range(12)]
    anchors = spark.createDataFrame([(u, T0 + timedelta(minutes=20 * u)) for u in range(3)], "user long, start timestamp")
    more = dict(ts="ts", anchor="start", tie="id", measures={"v": F.col("v"), "double": F.col("v") * 2}, hours=(1, 3, 6))
    for part in (data[::2], data[1::2]):
        write(spark, tmp_path / "in", part)
    events = event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    run_snapshot(events, anchors, ["user"], out=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"), **more).awaitTermination(120)
    want = snapshot_panel(spark.createDataFrame(data, SCHEMA), anchors, ["user"], **more)
    got = snapshot_rows(spark, str(tmp_path / "out"), ["user"], ["v", "double"], (1, 3, 6))
    assert got.columns == want.columns and rows(got, "user", "hour") == rows(want, "user", "hour")
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 2
    compact_parts(spark, str(tmp_path / "out"), str(tmp_path / "small"), ["user"], ["v", "double"])
    model = Pipeline(stages=[VectorAssembler(inputCols=["n_events"], outputCol="features"), GBTClassifier(maxIter=1)]).fit(
        spark.createDataFrame([(1, 0.0), (5, 1.0), (2, 0.0), (9, 1.0)], "n_events long, label double"))
    again = snapshot_rows(spark, str(tmp_path / "small"), ["user"], ["v", "double"], (1, 3, 6), model)
    assert rows(again.select(*want.columns), "user", "hour") == rows(want, "user", "hour") and "score" in again.columns
