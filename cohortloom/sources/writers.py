"""Writers of tables and their way back in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_panel(panel: DataFrame, path: str, hour: str = "hour") -> None:
    """One folder per snapshot hour, so that reading an hour skips the others."""
    panel.write.mode("overwrite").partitionBy(hour).parquet(path)


def read_panel(spark: SparkSession, path: str, hours: Sequence[int] | None = None, hour: str = "hour") -> DataFrame:
    """All hours, or only the folders of the given ones."""
    df = spark.read.parquet(path)
    return df if hours is None else df.filter(F.col(hour).isin(list(hours)))


def write_extract(df: DataFrame, path: str, first_day: str, last_day: str) -> None:
    """A table of one date range; extracts of other ranges under the same path stay."""
    target = f"{path}/first_day={first_day}/last_day={last_day}"
    df.write.mode("overwrite").parquet(target)


def read_extract(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for name, value in (("first_day", first_day), ("last_day", last_day)):
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value).cast(df.schema[name].dataType))
    return df


def write_keyed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """A catalog table bucketed and sorted by its keys: joins of two such tables on the keys need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
