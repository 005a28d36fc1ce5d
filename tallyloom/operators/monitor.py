"""Workflow logs: normalised entries, task states and run status (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The log line that reports a task state, and the status names of a run.
STATE_LINE = r"Marking task as (\w+)\..*task_id=([\w.-]+)"
FAILED = "dag_failed"
SUCCEEDED = "dag_succeeded"
TIMED_OUT = "monitoring_timed_out"
TOOL_ERROR = "error_in_tool"


def normalise_entries(raw: DataFrame) -> DataFrame:
    """Text payload kept, other payloads as JSON text and marked as not text."""
    return raw.select(
        "timestamp", F.coalesce("severity", F.lit("DEFAULT")).alias("severity"),
        F.coalesce("text_payload", F.to_json("json_payload")).alias("payload"),
        F.col("text_payload").isNotNull().alias("is_text"),
        "log_name", "resource_type", "resource_labels", "dag_id")


def scan_logs(logs: DataFrame, after, resource_type: str | None = None,
              environment: str | None = None, location: str | None = None,
              log_name: str | None = None, dag_id: str | None = None) -> DataFrame:
    """Entries strictly later than ``after``; each further filter applies when given.

    The run id is looked for in text payloads only.
    """
    found = logs.where(F.col("timestamp") > F.to_timestamp(F.lit(after)))
    if resource_type:
        found = found.where(F.col("resource_type") == resource_type)
    if environment:
        found = found.where(F.col("resource_labels")["environment_name"] == environment)
    if location:
        found = found.where(F.col("resource_labels")["location"] == location)
    if log_name:
        found = found.where(F.col("log_name").rlike(log_name))
    if dag_id:
        found = found.where(F.col("payload").contains(dag_id))
        if "is_text" in logs.columns:
            found = found.where("is_text")
    return found


def in_time_order(logs: DataFrame) -> DataFrame:
    return logs.orderBy("timestamp")


def state_changes(logs: DataFrame) -> DataFrame:
    """(dag, task, state, time) of the lines that report a task state; text payloads only.

    With several ``task_id=`` in a line the last one counts.
    """
    payload = F.col("payload")
    is_state_line = payload.rlike(STATE_LINE)
    if "is_text" in logs.columns:
        is_state_line = is_state_line & F.col("is_text")
    line = F.struct(
        "dag_id", F.regexp_extract(payload, STATE_LINE, 2).alias("task_id"),
        F.upper(F.regexp_extract(payload, STATE_LINE, 1)).alias("state"), "timestamp")
    # Not a filter: that would be moved below a stream's watermark, and then the lines
    # without a state would no longer move the clock that ends overdue runs.
    return logs.select(F.inline(F.when(is_state_line, F.array(line))))


def latest_states(changes: DataFrame) -> DataFrame:
    """Last state per task with its time, and whether the task ever failed; equal times go
    to the later name."""
    last = F.max(F.struct("timestamp", "state")).alias("last")
    return changes.groupBy("dag_id", "task_id").agg(
        last, F.bool_or(F.col("state") == "FAILED").alias("ever_failed"),
    ).select("dag_id", "task_id", "last.*", "ever_failed")


def merge_states(*known: DataFrame) -> DataFrame:
    """One state table out of several results of :func:`latest_states`."""
    whole = known[0]
    for states in known[1:]:
        whole = whole.unionByName(states)
    return whole.groupBy("dag_id", "task_id").agg(
        F.max(F.struct("timestamp", "state")).alias("last"), F.bool_or("ever_failed").alias("ever_failed"),
    ).select("dag_id", "task_id", "last.*", "ever_failed")


def task_states(changes: DataFrame) -> DataFrame:
    return latest_states(changes).drop("timestamp")


def status_of(any_failed: Column, all_success: Column) -> Column:
    return F.when(any_failed, FAILED).when(all_success, SUCCEEDED).otherwise(TIMED_OUT)


def run_status(states: DataFrame, expected_tasks: DataFrame | None = None) -> DataFrame:
    """Status per run: failed if any task failed, succeeded if all known tasks succeeded.

    Tasks that have not logged yet are unknown and do not hold success back, unless
    ``expected_tasks`` (dag_id, task_id) lists them.
    """
    known = states.select("dag_id", "task_id", "state", "ever_failed")
    if expected_tasks is not None:
        known = known.join(expected_tasks, ["dag_id", "task_id"], "full").fillna(
            {"ever_failed": False, "state": "UNKNOWN"})
    return known.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("tasks"),
        status_of(F.bool_or("ever_failed"), F.every(F.col("state") == "SUCCESS")).alias("status"))
