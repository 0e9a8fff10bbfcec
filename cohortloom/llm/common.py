"""What the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this library, once per application, where they may not have it installed.

    Rows go to Python in batches of 1,000 unless the session names another size: ten thousand whole texts at once cost each
    task more memory than all else here.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    sc = spark.sparkContext
    if getattr(sc, "_cohortloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="cohortloom-"), "cohortloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._cohortloom_shipped = True


def written(df: DataFrame, label: str) -> DataFrame:
    """Compute now and read back from the shared folder: cuts the lineage, survives lost executors, keeps columns prunable."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed(array: Column) -> Column:
    """To be selected: a column that later filters and lambdas read and do not compute anew. The optimiser moves neither into a generator."""
    return F.explode_outer(F.array(array))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def mixed(v: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, so that sums and products of hashes spread over all bits."""
    v = v ^ (v >> np.uint64(33))
    v = v * np.uint64(0xFF51AFD7ED558CCD)
    v = v ^ (v >> np.uint64(33))
    v = v * np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))
