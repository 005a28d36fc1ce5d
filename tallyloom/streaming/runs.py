"""Running streams over landed files, and where their rows go."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.staging import new_path

POLL = "60 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                files_per_trigger: int | None = None) -> DataFrame:
    """Files below ``path`` as a stream; the checkpoint's file log is the read cursor."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def triggered(writer, poll: str | None):
    return writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)


def append_to(stream: DataFrame, path: str, checkpoint: str, poll: str | None = None):
    """Append finished rows to a parquet table, exactly once."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return triggered(writer, poll).start()


def update_to(stream: DataFrame, path: str, checkpoint: str, poll: str | None = None):
    """Write each batch's changed rows under its batch id; a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    writer = (stream.writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return triggered(writer, poll).start()


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Current row per key of a table written by :func:`update_to`."""
    rest = [c for c in schema.names if c not in keys]
    whole = T.StructType(list(schema.fields) + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(whole).parquet(path)
    return rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("r")).select(
        *keys, *[F.col(f"r.{c}") for c in rest])


def run_now(stream: DataFrame, start: Callable, label: str) -> str:
    """Process what has landed so far to its end; the path of the table written.

    The number of state partitions is fixed at a stream's first start: at most one per core.
    """
    spark = stream.sparkSession
    path = new_path(spark, label)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        query = start(stream, f"{path}/table", f"{path}/checkpoint")
    finally:
        spark.conf.set(setting, before)
    # Only the last progress reports are kept, so they are collected while the stream runs.
    dropped: dict[int, int] = {}
    done = False
    while not done:
        done = query.awaitTermination(1)
        for progress in query.recentProgress:
            dropped[progress["batchId"]] = sum(
                int(o.get("numRowsDroppedByWatermark", 0)) for o in progress["stateOperators"])
    late = sum(dropped.values())
    if late:
        warnings.warn(f"{label}: {late} rows came later than the watermark and were dropped",
                      stacklevel=2)
    return f"{path}/table"
