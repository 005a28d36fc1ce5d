"""Metric series: latest points and what may be exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions.scalars import moment

WINDOW_MINUTES = 5


def scan_series(metrics: DataFrame, as_of, metric: str | None = None,
                labels: dict[str, str] | None = None, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Points of the interval that ends at ``as_of``, filtered by metric and labels when given."""
    end = moment(as_of)
    found = metrics.where((F.col("ts") >= end - F.expr(f"INTERVAL {minutes} MINUTES"))
                          & (F.col("ts") <= end))
    if metric:
        found = found.where(F.col("metric") == metric)
    for name, value in (labels or {}).items():
        found = found.where(F.col("labels")[name] == value)
    return found


def latest_points(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value per series; of equal times the larger value."""
    return metrics.groupBy(*keys).agg(F.max(F.struct("ts", "value"))["value"].alias("value"))


def latest_or_zero(wanted: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value for each wanted series, 0.0 where the interval holds no point."""
    return wanted.select(*keys).distinct().join(latest_points(points, keys), keys, "left").fillna(
        0.0, ["value"])


def latest_per_window(metrics: DataFrame, keys: list[str], minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Latest value of each series in every tumbling window (batch and streaming)."""
    return metrics.groupBy(F.window("ts", f"{minutes} minutes"), *keys).agg(
        F.max(F.struct("ts", "value"))["value"].alias("value"),
    ).select(F.col("window.start").alias("window_start"), *keys, "value")


def exportable(metrics: DataFrame) -> DataFrame:
    """Allow-listed metrics without their sensitive labels."""
    return metrics.where(P.is_exportable_metric(F.col("metric"))).withColumn(
        "labels", P.safe_labels(F.col("labels")))


def counter_totals(increments: DataFrame, counter: str = "counter") -> DataFrame:
    """Cumulative counters: events per counter name (batch and streaming)."""
    return increments.groupBy(counter).agg(F.count(F.lit(1)).alias("total"))
