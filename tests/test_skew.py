"""One key with a third of the rows: results stay whole and the work is split."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.operators import assets, lifecycle, querylog, repos
from tallyloom.streaming import monitor as live
from tallyloom.operators import monitor
from tallyloom.streaming import runs

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(n, key="key", other=500):
    return F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % other).cast("long").alias(key)


def test_hot_query_in_the_content_join_is_split(spark, small_partitions):
    n = 120_000
    edges = spark.range(n, numPartitions=8).select(F.col("id").alias("dashboard_id"), hot(n, "query_id"))
    scores = spark.range(500).select("id", (F.col("id") + 0.5).alias("golden_query_score"))
    sums = assets.content_sums(edges, scores)
    total = sums.agg(F.sum("raw_content_score"), F.count(F.lit(1)), F.sum("query_count"))
    row = total.collect()[0]
    want = sum(7.5 if i % 3 == 0 else i % 500 + 0.5 for i in range(n))
    assert row[0] == pytest.approx(want) and row[1] == row[2] == n
    assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()


def test_hot_query_counts(spark):
    n = 60_000
    edges = spark.range(n, numPartitions=8).select(
        F.col("id").alias("widget_id"), (F.col("id") % 9_000).alias("dashboard_id"), hot(n, "query_id"))
    got = {r.query_id: (r.downstream_dashboard_count, r.downstream_chart_count)
           for r in assets.downstream_counts(edges).collect()}
    want = {r.query_id: (r.d, r.w) for r in edges.groupBy("query_id").agg(
        F.countDistinct("dashboard_id").alias("d"), F.countDistinct("widget_id").alias("w")).collect()}
    assert got == want


def test_hot_repository(spark):
    n = 50_000
    commits = spark.range(n, numPartitions=8).select(
        F.lit("o").alias("org"), hot(n, "repo").cast("string"), F.sha2((F.col("id") % 40_000).cast("string"), 256).alias("sha"))
    got = {r.repo: r.commits for r in repos.commit_counts(commits).collect()}
    want = {r.repo: r.n for r in commits.groupBy("repo").agg(F.countDistinct("sha").alias("n")).collect()}
    assert got == want


def test_hot_document_text_is_whole(spark):
    n = 9_000
    notes = spark.range(n, numPartitions=8).select(
        hot(n, "document_id", 300), F.col("id").alias("at"), F.concat(F.lit("b"), F.col("id")).alias("body"))
    parts = lifecycle.feedback_text(notes, ["at"], F.floor(F.col("at") / 128), size=100)
    sizes = [r.feedback_count for r in parts.collect()]
    assert max(sizes) == 100 and sum(sizes) == n
    whole = " | ".join(r.feedback for r in parts.where("document_id = 7").orderBy("segment").collect())
    assert whole == " | ".join(f"b{i}" for i in range(n) if i % 3 == 0 or i % 300 == 7)


def test_hot_instant(spark):
    rows = spark.range(30_000, numPartitions=8).select(
        F.lit("s").alias("query_shape_id"),
        F.timestamp_micros(F.when(F.col("id") % 3 == 0, F.lit(10**15)).otherwise(10**15 + F.col("id") * 10**6))
        .alias("creation_time"))
    got = querylog.shape_regularity(rows).first()
    want = rows.selectExpr("unix_micros(creation_time) / 1e6 - lag(unix_micros(creation_time) / 1e6) over "
                           "(partition by query_shape_id order by creation_time) g").agg(F.stddev_samp("g")).first()[0]
    assert got.execution_regularity_stdev == pytest.approx(want, rel=1e-6)


def test_replayed_run_of_one_task(spark, folder):
    """Scheduler and worker lines of one run, of which a single one reports a state."""
    start = datetime(2024, 5, 1, 10)
    lines = [f"[{i}] Dependencies all met for dag_id=profile_run" for i in range(18)]
    lines += [f"Running step {i}" for i in range(18)]
    lines.append("Marking task as SUCCESS. dag_id=profile_run, task_id=run_profile, run_id=manual__1, "
                 "execution_date=20240501, start_date=20240501, end_date=20240501")
    with open(f"{folder}/log.json", "w") as out:
        for i, text in enumerate(lines):
            out.write(json.dumps({
                "timestamp": (start + timedelta(milliseconds=300 * i)).isoformat() + "+00:00", "severity": "INFO",
                "text_payload": text, "log_name": "projects/p/logs/airflow-worker", "dag_id": "profile_run",
                "resource_type": "cloud_composer_environment", "resource_labels": {"location": "eu"}}) + "\n")
    raw = runs.read_stream(spark, folder, schemas.RAW_LOG_ENTRIES)
    path = runs.run_now(monitor.normalise_entries(raw), live.follow_to, "replay")
    statuses = live.run_statuses(spark, path)
    assert [tuple(r) for r in statuses.collect()] == [("profile_run", "dag_succeeded", 1)]
