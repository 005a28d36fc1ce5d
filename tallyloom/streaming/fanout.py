"""One stream of submissions to several destinations, written in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Destination = tuple[str, Callable[[DataFrame, int], None]]


def parquet_destination(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def json_destination(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")
    return write


def fan_out(destinations: list[Destination], counters: str):
    """``foreachBatch`` function: write a batch to every destination in order.

    After each success the number of rows written is recorded under ``counters``.  A
    failure aborts the rest, what was written stays, and the batch is retried under the
    same batch id, so a retry replaces its own partial writes.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            for position, (name, send) in enumerate(destinations):
                seen = Observation()
                send(batch.observe(seen, F.count(F.lit(1)).alias("rows")), batch_id)
                done = [(name, int(seen.get["rows"]))]
                (spark.createDataFrame(done, "destination string, rows long").write
                 .mode("overwrite")
                 .json(f"{counters}/batch_id={batch_id}/position={position}"))
        finally:
            batch.unpersist()
    return write


def success_totals(counters: DataFrame) -> DataFrame:
    """Cumulative rows per destination."""
    return counters.groupBy("destination").agg(F.sum("rows").alias("total"))
