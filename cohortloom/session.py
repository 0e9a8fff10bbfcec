"""Session helpers shared by tests, the bench and the driver entry point."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cohortloom") -> SparkSession:
    """A single-JVM session. On a cluster use the session the cluster gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names, or a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


ROWS_PER_PART = 1_000_000
LEAST_PARTS = 8


def written_once(df: DataFrame, spread_by: str | None = None) -> DataFrame:
    """Compute now and keep as parquet on shared storage: for tables that several later jobs read, each only its columns.

    `spread_by` names a unique key for work that is bound by cores rather than bytes (training): the rows are dealt by it
    into parts whose number follows from the number of rows alone, and sorted by it, so that what draws per part draws
    alike on any cluster.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    if spread_by is None:
        return kept
    parts = max(LEAST_PARTS, -(-kept.count() // ROWS_PER_PART))
    return kept.repartition(parts, spread_by).sortWithinPartitions(spread_by)
