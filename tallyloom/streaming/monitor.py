"""Following workflow runs live: task states, run status, and the monitor's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.operators import monitor as M
from tallyloom.streaming.runs import triggered
from tallyloom.streaming.states import BUCKETS, StateTable

LOOK_BACK = "15 minutes"
MAX_MINUTES = 30

STATUS_SCHEMA = "dag_id string, status string, tasks long"
_TASKS = ("dag_id string, task_id string, timestamp timestamp, state string, ever_failed boolean,"
          " first timestamp, prior string, changed boolean")
_RUNS = ("dag_id string, tasks long, open_tasks long, failed boolean, first timestamp, status string,"
         " finished_in long")


def task_states(logs: DataFrame) -> DataFrame:
    """Streaming last state per task: a built-in aggregation with map-side combine."""
    return M.task_states(M.state_changes(logs))


def task_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StateTable:
    """Last state of every task; ``prior`` and ``changed`` say what its last batch made of it.

    A run's tasks are dealt over all buckets, so several tasks work on a hot run.
    """
    return StateTable(spark, f"{path}/task_states", _TASKS, ["dag_id", "task_id"], buckets)


def run_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> StateTable:
    """Counts of every run's tasks, and its status once it has one."""
    return StateTable(spark, f"{path}/runs", _RUNS, ["dag_id"], buckets)


def _folded(changes: DataFrame) -> DataFrame:
    """State lines of a batch, folded to one row a task."""
    return changes.groupBy("dag_id", "task_id").agg(
        F.max(F.struct("timestamp", "state")).alias("last"),
        F.bool_or(F.col("state") == "FAILED").alias("ever_failed"), F.min("timestamp").alias("first"),
    ).select("dag_id", "task_id", "last.*", "ever_failed", "first")


def _merged(before: DataFrame, new: DataFrame) -> DataFrame:
    columns = ["dag_id", "task_id", "timestamp", "state", "ever_failed", "first"]
    both = (before.select(*columns, F.lit(False).alias("new"))
            .unionByName(new.select(*columns, F.lit(True).alias("new"))))
    return both.groupBy("dag_id", "task_id").agg(
        F.max(F.struct("timestamp", "state")).alias("last"), F.bool_or("ever_failed").alias("ever_failed"),
        F.min("first").alias("first"), F.max(F.when(~F.col("new"), F.col("state"))).alias("prior"),
        F.bool_or("new").alias("changed"),
    ).select("dag_id", "task_id", "last.*", "ever_failed", "first", "prior", "changed")


def _run_changes(tasks: DataFrame) -> DataFrame:
    """What the changed tasks of a batch add to their runs' counts."""
    now = (F.col("state") != "SUCCESS").cast("long")
    then = F.coalesce((F.col("prior") != "SUCCESS").cast("long"), F.lit(0).cast("long"))
    return tasks.where("changed").groupBy("dag_id").agg(
        F.count_if(F.col("prior").isNull()).alias("tasks"), F.sum(now - then).alias("open_tasks"),
        F.bool_or("ever_failed").alias("failed"), F.min("first").alias("first"))


def _run_states(before: DataFrame, changes: DataFrame, batch_id: int, overdue: int | None) -> DataFrame:
    """Runs after a batch; ``overdue``: runs that began up to this moment (micros) have run out of time."""
    none = changes.withColumn("status", F.lit(None).cast("string")).withColumn(
        "finished_in", F.lit(None).cast("long"))
    sums = before.unionByName(none).groupBy("dag_id").agg(
        F.max(F.when(F.col("status").isNotNull(), F.col("tasks"))).alias("had"),
        F.sum("tasks").alias("tasks"), F.sum("open_tasks").alias("open_tasks"),
        F.bool_or("failed").alias("failed"), F.min("first").alias("first"),
        F.max("status").alias("known"), F.max("finished_in").alias("finished_in"))
    late = F.lit(False) if overdue is None else F.unix_micros("first") <= overdue
    status = F.coalesce("known", F.when(F.col("failed"), M.FAILED)
                        .when((F.col("open_tasks") == 0) & (F.col("tasks") > 0), M.SUCCEEDED)
                        .when(late, M.TIMED_OUT))
    return sums.withColumn("status", status).select(
        # A finished run stays as it was when it ended.
        "dag_id", F.coalesce("had", "tasks").alias("tasks"), "open_tasks", "failed", "first", "status",
        F.coalesce("finished_in", F.when(F.col("status").isNotNull(), F.lit(batch_id).cast("long")))
         .alias("finished_in"))


def follow_runs(path: str, look_back: str | None = LOOK_BACK, max_minutes: int = MAX_MINUTES,
                buckets: int = BUCKETS, keep_logs: bool = False):
    """``foreachBatch`` sink that follows runs and their tasks in state tables below ``path``.

    A run failed on the first batch in which any of its tasks turns FAILED, it succeeded once all
    known tasks are SUCCESS, and it timed out when event time passes its first line by
    ``max_minutes``; later lines do not change a finished run.  Lines more than ``look_back`` behind
    the newest line of the batches before go to ``late`` instead (None: no line is late).  A batch is
    folded to a row a task and merged into the buckets of those tasks; what that changes is added to
    the counts of the runs, so no task reads a whole run.  With ``keep_logs`` all lines are kept, too.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tasks, runs = task_table(spark, path, buckets), run_table(spark, path, buckets)
        tasks_before, runs_before = tasks.version(batch_id), runs.version(batch_id)
        note = runs_before.note
        newest = note.get("newest")
        bound = None if look_back is None or newest is None else newest - _micros(spark, look_back)
        is_late = F.lit(False) if bound is None else F.coalesce(
            F.unix_micros("timestamp") <= bound, F.lit(False))
        batch.persist()
        try:
            seen = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_late).alias("late"),
                             F.max(F.unix_micros("timestamp")).alias("newest")).first()
            if keep_logs:
                batch.write.mode("overwrite").parquet(f"{path}/logs/batch_id={batch_id}")
            if seen["late"]:
                batch.where(is_late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            new = _folded(M.state_changes(batch.where(~is_late)))
            touched = tasks.touched(new)
            written = tasks.replace(batch_id, _merged(tasks.rows(tasks_before, touched), new),
                                    touched) if touched else tasks.rows(tasks_before, [])
        finally:
            batch.unpersist()
        newest = max((n for n in (newest, seen["newest"]) if n is not None), default=None)
        overdue = None if newest is None else newest - _micros(spark, look_back or "0 seconds") \
            - max_minutes * 60_000_000
        changes = _run_changes(written)
        due = {int(k): first for k, first in note.get("due", {}).items()}
        of_runs = sorted({*runs.touched(changes), *(
            k for k, first in due.items() if overdue is not None and first <= overdue)})
        if of_runs:
            states = runs.replace(batch_id, _run_states(
                runs.rows(runs_before, of_runs), changes, batch_id, overdue), of_runs)
            open_runs = states.where("status IS NULL").groupBy(runs.bucket().alias("k")).agg(
                F.min(F.unix_micros("first")).alias("first"))
            due = {k: first for k, first in due.items() if k not in of_runs} | {
                r["k"]: r["first"] for r in open_runs.collect()}
        tasks.commit(batch_id, tasks_before, touched)
        runs.commit(batch_id, runs_before, of_runs, {
            "newest": newest, "due": due, "rows": note.get("rows", 0) + seen["rows"],
            "late": note.get("late", 0) + seen["late"]})
    return write


def _micros(spark: SparkSession, span: str) -> int:
    """Microseconds of an interval such as ``15 minutes``."""
    return spark.range(1).select(F.unix_micros(F.expr(f"timestamp_micros(0) + INTERVAL {span}"))).first()[0]


def follow_to(stream: DataFrame, path: str, checkpoint: str, poll: str | None = None, **options):
    """Start a stream of log lines into :func:`follow_runs`."""
    writer = (stream.writeStream.foreachBatch(follow_runs(path, **options))
              .option("checkpointLocation", checkpoint))
    return triggered(writer, poll).start()


def run_statuses(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """dag_id, status and tasks of the runs that have ended."""
    return run_table(spark, path, buckets).rows().where("status IS NOT NULL").select(
        "dag_id", "status", "tasks")


def followed_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Last state of every task, with its time and whether it ever failed."""
    return task_table(spark, path, buckets).rows().select(
        "dag_id", "task_id", "timestamp", "state", "ever_failed")


def summary(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """dag_id, tasks and status of every run seen; one that has not ended is out of time so far."""
    return run_table(spark, path, buckets).rows().select(
        "dag_id", "tasks", F.coalesce("status", F.lit(M.TIMED_OUT)).alias("status"))


def line_counts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Lines read, and those of them that came late, over all batches."""
    note = run_table(spark, path, buckets).version().note
    return {"rows": note.get("rows", 0), "late": note.get("late", 0)}


def run_outcomes(runs: DataFrame, statuses: DataFrame,
                 query: StreamingQuery | None = None) -> DataFrame:
    """Final status of every watched run.

    ``statuses`` are the rows of :func:`run_statuses`.  A run without one ended in a tool
    error when the stream itself failed, else the monitoring time ran out.
    """
    failed = query is not None and query.exception() is not None
    missing = M.TOOL_ERROR if failed else M.TIMED_OUT
    known = statuses.groupBy("dag_id").agg(F.min("status").alias("status"))
    return runs.select("dag_id").distinct().join(known, "dag_id", "left").fillna(
        missing, ["status"])
