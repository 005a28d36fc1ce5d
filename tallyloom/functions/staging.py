"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="run-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a scratch folder."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors can reach")
    return _local_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute it nor depend on
    the executors that did."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes of the files that one task works on where a row costs far more than its scan: some 100,000 rows
# of a query log.
PIECE = 2 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A file scan for costly per-row work: rows are dealt to all cores, and to more tasks as the files
    grow, when the files give fewer splits than that.  A scan with enough splits is returned as it is,
    unshuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = max(cores, -(-size // PIECE))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
