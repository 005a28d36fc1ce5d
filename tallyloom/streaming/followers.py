"""Streaming twins of the aggregations over events and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import lifecycle, metrics
from tallyloom.streaming.runs import triggered
from tallyloom.streaming.states import BUCKETS, StateTable, fold_into

LATENESS = "15 minutes"
_PROGRESS = "task_id {}, last struct<ts:timestamp,stage:string,status:string>, progress int, ticks long"


def task_progress(path: str, body: str = "value", buckets: int = BUCKETS, id_type: str = "string"):
    """Sink for event JSON: stage, progress and completion per task in a state table at ``path``.

    A task that is finished or idle lies in its bucket and costs nothing; a late event resumes the
    stored progress.  :func:`progress_rows` reads the table.
    """
    return fold_into(
        lambda spark: StateTable(spark, path, _PROGRESS.format(id_type), ["task_id"], buckets),
        lambda batch: lifecycle.progress_state(lifecycle.parse_events(batch, body)),
        lifecycle.merged_progress)


def progress_rows(spark: SparkSession, path: str, buckets: int = BUCKETS,
                  id_type: str = "string") -> DataFrame:
    table = StateTable(spark, path, _PROGRESS.format(id_type), ["task_id"], buckets)
    return lifecycle.shown_progress(table.rows())


def _snapshots(spark: SparkSession, path: str, fields: list[str], buckets: int,
               id_type: str) -> StateTable:
    writes = ", ".join(f"`{f}` struct<ts:timestamp,value:string>" for f in fields)
    return StateTable(spark, path, f"task_id {id_type}, {writes}", ["task_id"], buckets)


def task_snapshot(path: str, fields: list[str], buckets: int = BUCKETS, id_type: str = "string"):
    """Sink for field writes: the last value per field and task in a state table at ``path``;
    :func:`snapshot_rows` reads it."""
    return fold_into(lambda spark: _snapshots(spark, path, fields, buckets, id_type),
                     lambda batch: lifecycle.snapshot_state(batch, fields),
                     lambda states: lifecycle.merged_snapshots(states, fields))


def snapshot_rows(spark: SparkSession, path: str, fields: list[str], buckets: int = BUCKETS,
                  id_type: str = "string") -> DataFrame:
    return lifecycle.shown_snapshot(_snapshots(spark, path, fields, buckets, id_type).rows(), fields)


def sink_to(sink: Callable, **options):
    """A start function for :func:`runs.run_now`: the stream goes into ``sink(path, **options)``."""
    def start(stream: DataFrame, path: str, checkpoint: str, poll: str | None = None):
        writer = stream.writeStream.foreachBatch(sink(path, **options))
        return triggered(writer.option("checkpointLocation", checkpoint), poll).start()
    return start


def counter_totals(increments: DataFrame, counter: str = "counter") -> DataFrame:
    """Running totals per counter (update mode)."""
    return metrics.counter_totals(increments, counter)


def latest_metrics(points: DataFrame, keys: list[str], minutes: int = metrics.WINDOW_MINUTES,
                   lateness: str = LATENESS) -> DataFrame:
    """Latest value per series and window, emitted once the window can no longer change."""
    return metrics.latest_per_window(points.withWatermark("ts", lateness), keys, minutes)


def of_task(events: DataFrame, task_id) -> DataFrame:
    return lifecycle.of_task(events, task_id)
