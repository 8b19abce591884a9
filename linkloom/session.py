"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    # every date column is UTC epoch milliseconds
    "spark.sql.session.timeZone": "UTC",
    # hot link targets and terms: split the large side of a join at run time,
    # also when the split costs one more exchange
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that go to Python hold whole pages and texts: bound a batch by rows and bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}

# how finely a shuffle is cut before Spark joins its small parts again: a task's share must not grow with the tables
SHUFFLE_PARTS = 480
# shuffled bytes that one task is given where Spark joins parts: rows of URIs and titles take ten times that and more in memory
PART_BYTES = "8m"


def fine_shuffles(spark: SparkSession) -> None:
    """Cut each shuffle finely; adaptive execution puts small parts together by their measured size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(SHUFFLE_PARTS))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_BYTES)


def configure(spark: SparkSession) -> SparkSession:
    fine_shuffles(spark)
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A machine-local folder is used only where driver and executors are one process, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="linkloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def write_once(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of rows that several parts of a plan read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps never recompute them and know their size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
