"""Logs landed so that files and row groups are skipped."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import scans, sinks

SCHEMA = "id long, project string, run string, at timestamp"


def rows_read(df):
    """Rows that the scan handed on, before the filter."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, scan.metrics().get("numOutputRows").get().value()


def test_row_groups_and_days_are_skipped(spark, folder):
    n = 400_000
    # A third of the rows are of one project; runs lie scattered over every day and project.
    log = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(500)))).alias("project"),
        F.sha2(F.col("id").cast("string"), 256).alias("run"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 4 as int), 0, 0, id % 86400)").alias("at"))
    log = log.unionByName(spark.createDataFrame([(-1, "p1", None, None)], log.schema))
    path = f"{folder}/landed"
    sinks.write_landed(log, path, "at", ["project"], ["run"], row_group_bytes=256 << 10)
    read = lambda **kw: scans.read_landed(spark, path, SCHEMA, "at", **kw)
    assert read().columns == log.columns and read().count() == n + 1
    assert read(project="p1").where("at is null").count() == 1

    one_project, opened = rows_read(read(project="p77"))
    assert len(one_project) == log.where("project = 'p77'").count() and opened < n / 10
    run = log.where("id = 123456").first()["run"]
    one_run, opened = rows_read(read(run=run))
    assert [r["id"] for r in one_run] == [123456] and opened < n / 10
    part, opened = rows_read(read(start="2024-01-02 06:00:00", until="2024-01-02 12:00:00"))
    want = log.where("at >= '2024-01-02 06:00:00' and at < '2024-01-02 12:00:00'").count()
    assert len(part) == want and opened <= n / 4 + 1


def test_the_day_column_must_be_free(spark, folder):
    with pytest.raises(ValueError):
        sinks.write_landed(spark.sql("select 1 as id, current_timestamp() as at, 2 as day"), f"{folder}/x", "at", ["id"])
    empty = spark.createDataFrame([], SCHEMA)
    sinks.write_landed(empty, f"{folder}/y", "at", ["project"])
    assert scans.read_landed(spark, f"{folder}/y", SCHEMA, "at", project="p").isEmpty()
