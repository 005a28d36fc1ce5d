"""Task, document and feedback state folded from append-only change tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions.grouped import list_segments, number_rows, previous_value, time_bucket
from tallyloom.functions.scalars import MICROS_PER_SECOND
from tallyloom.schemas import TASK_EVENT_BODY

ANONYMOUS = "anonymous@example.com"
DONE_AT = 200
STATUS_EXTRAS = ("created_at", "started_at", "completed_at", "test_status")

# The stage changes a task may make.
STAGE_MOVES = [
    ("INIT", "PLANNING"),
    ("PLANNING", "WAIT_RFC"), ("PLANNING", "EXECUTING"),
    ("WAIT_RFC", "WAIT_RFC"), ("WAIT_RFC", "EXECUTING"), ("WAIT_RFC", "STOPPED"),
    ("EXECUTING", "EXECUTING"), ("EXECUTING", "DONE"), ("EXECUTING", "STOPPED"),
]


def state_snapshot(events: DataFrame, fields: list[str], key: str = "task_id") -> DataFrame:
    """Last written value of each field per task, one column per field.

    One aggregation for all fields; writes of a hot task are combined on the map side.
    Of equal times the greater value wins.
    """
    return shown_snapshot(snapshot_state(events, fields, key), fields, key)


def snapshot_state(events: DataFrame, fields: list[str], key: str = "task_id") -> DataFrame:
    """(time, value) of the last write of each field: what :func:`merged_snapshots` can go on from."""
    return events.groupBy(key).agg(*[
        F.max(F.when(F.col("field") == f, F.struct("ts", "value"))).alias(f) for f in fields])


def merged_snapshots(states: DataFrame, fields: list[str], key: str = "task_id") -> DataFrame:
    return states.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])


def shown_snapshot(states: DataFrame, fields: list[str], key: str = "task_id") -> DataFrame:
    return states.select(key, *[F.col(f)["value"].alias(f) for f in fields])


def with_durations(snapshot: DataFrame) -> DataFrame:
    """Queue and run seconds from the created, started and completed times."""
    def micros(c: str) -> Column:
        return F.unix_micros(F.try_to_timestamp(F.col(c)))

    def seconds(a: str, b: str) -> Column:
        return (micros(b) - micros(a)) / F.lit(float(MICROS_PER_SECOND))
    return (snapshot.withColumn("queue_seconds", seconds("created_at", "started_at"))
            .withColumn("run_seconds", seconds("started_at", "completed_at")))


def status_response(snapshot: DataFrame) -> DataFrame:
    """Status label of each task; error text only for failed ones, details from its JSON, and the
    times and test status that the snapshot has."""
    status = P.status_label(F.col("state"), F.col("pr_url"))
    detail = [F.get_json_object("task_json", f"$.{f}").alias(f)
              for f in ("instructions", "repo", "engine")]
    return snapshot.select(
        "task_id", F.coalesce("state", F.lit("unknown")).alias("state"), status.alias("status"),
        F.when(status == "COMPLETED", F.col("pr_url")).alias("pr_url"),
        F.when(status == "FAILED", F.coalesce("error", F.lit("Unknown error"))).alias("error"),
        *detail, *[c for c in STATUS_EXTRAS if c in snapshot.columns])


def recent_tasks(tasks: DataFrame, user_id, n: int = 50) -> DataFrame:
    """The latest ``n`` tasks of one user."""
    return tasks.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "id").limit(n)


def recent_tasks_per_user(tasks: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` tasks of every user; the limit is applied before the shuffle too."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return tasks.withColumn("position", F.row_number().over(latest)).where(F.col("position") <= n)


def tasks_of_users(users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks with the e-mail of their owner."""
    owners = users.select(F.col("id").alias("user_id"), "email")
    return tasks.join(owners, "user_id")


def uuid_of(text: Column) -> Column:
    """A UUID that depends on the text only: a recomputed task gives the same one."""
    digest = F.md5(text)
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def ensure_users(users: DataFrame, wanted: DataFrame, request: str | None = None) -> DataFrame:
    """Users after get-or-create, by id where ``wanted`` has one that is known, else by e-mail.

    A missing address becomes an anonymous one: of its own for each value of the column
    ``request`` when that is named, else one for all.
    """
    if "id" in wanted.columns:
        known = users.select(F.col("id").alias("_id"))
        wanted = wanted.join(known, F.col("id") == F.col("_id"), "left_anti")
    name, _, host = ANONYMOUS.partition("@")
    missing = F.lit(ANONYMOUS) if request is None else F.concat(
        F.lit(f"{name}-"), uuid_of(F.col(request).cast("string")), F.lit(f"@{host}"))
    emails = wanted.select(F.coalesce(F.nullif("email", F.lit("")), missing)
                           .alias("email")).distinct()
    new = emails.join(users, "email", "left_anti").select(
        uuid_of(F.col("email")).alias("id"), "email")
    return users.select("id", "email").unionByName(new)


def feedback_of(document_ids: DataFrame, feedback: DataFrame) -> DataFrame:
    return feedback.join(document_ids, "document_id", "left_semi")


def feedback_text(feedback: DataFrame, order: list[str], bucket: Column, size: int = 1_000,
                  separator: str = " | ") -> DataFrame:
    """Feedback per document in order, joined by ``separator``, and its count.

    A document with more than ``size`` entries continues in segments 1, 2, ...
    """
    numbered = number_rows(feedback.select("document_id", "body", *order), ["document_id"], order, bucket)
    parts = list_segments(numbered, ["document_id"], "body", size, "bodies")
    return parts.select("document_id", "segment",
                        F.array_join("bodies", separator).alias("feedback"),
                        F.size("bodies").cast("long").alias("feedback_count"))


def documents_with_feedback(documents: DataFrame, feedback: DataFrame, order: list[str],
                            bucket: Column) -> DataFrame:
    """All documents; null text and zero count where there is no feedback."""
    texts = feedback_text(feedback, order, bucket)
    return documents.join(texts, "document_id", "left").fillna(0, ["segment", "feedback_count"])


def latest_documents(documents: DataFrame, key: str = "task_id", version: str = "version",
                     carried: tuple[str, ...] = ("body",)) -> DataFrame:
    """Latest version per task, without sorting a task's versions."""
    last = F.max(F.struct(version, *carried))
    return documents.groupBy(key).agg(last.alias("d")).select(key, "d.*")


def fold_updates(changes: DataFrame, keys: list[str], fields: list[str], ts: str = "ts") -> DataFrame:
    """Current row per key of an append-only change log."""
    return changes.groupBy(*keys).agg(F.max(F.struct(ts, *fields)).alias("c")).select(*keys, "c.*")


def update_rows(current: DataFrame, updates: DataFrame, keys: list[str],
                ts: str | None = None) -> DataFrame:
    """Rows with the updated fields replaced, by null too; rows without an update stay as they are.

    Of several updates of a key the last by ``ts`` wins, of equal times, or without times, the
    largest values; so every row of ``current`` comes out once.
    """
    fields = [c for c in updates.columns if c not in keys and c != ts]
    order = [ts] if ts else []
    marked = updates.groupBy(*keys).agg(F.max(F.struct(*order, *fields)).alias("_new"))
    joined = current.join(marked, keys, "left")
    updated = F.col("_new").isNotNull()
    return joined.select(*[F.when(updated, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields
                           else F.col(c) for c in current.columns])


def unmatched_updates(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates that match no row: the not-found report."""
    return updates.join(current, keys, "left_anti")


# ---- progress events ----------------------------------------------------------------


def parse_events(raw: DataFrame, body: str = "value") -> DataFrame:
    """Event JSON into one struct that covers all event types."""
    return raw.withColumn("event", F.from_json(body, TASK_EVENT_BODY)).select(
        "task_id", "ts", "event.*")


def of_task(events: DataFrame, task_id) -> DataFrame:
    return events.where(F.col("task_id") == task_id)


def progress_fold(events: DataFrame) -> DataFrame:
    """Latest stage, highest progress and completion per task (batch and streaming)."""
    return shown_progress(progress_state(events))


def progress_state(events: DataFrame) -> DataFrame:
    """Last stage with its time, highest tick and number of ticks per task."""
    stage = F.when(F.col("type") == "stage", F.struct("ts", "stage", "status"))
    tick = F.when(F.col("type") == "tick", F.col("progress"))
    return events.groupBy("task_id").agg(
        F.max(stage).alias("last"), F.max(tick).alias("progress"),
        F.count_if(F.col("type") == "tick").alias("ticks"))


def merged_progress(states: DataFrame) -> DataFrame:
    return states.groupBy("task_id").agg(
        F.max("last").alias("last"), F.max("progress").alias("progress"), F.sum("ticks").alias("ticks"))


def shown_progress(states: DataFrame) -> DataFrame:
    progress = F.coalesce("progress", F.lit(0))
    return states.select("task_id", F.col("last.stage").alias("stage"), F.col("last.status").alias("status"),
                         progress.alias("progress"), "ticks", (progress >= DONE_AT).alias("done"))


def checked_stages(stages: DataFrame, order: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """Stage rows with the stage before and whether that move is allowed.

    The first row of a task is compared with INIT.
    """
    before = previous_value(stages, ["task_id"], order, time_bucket(F.col("ts"), bucket_seconds),
                            "stage", "from_stage")
    before = before.withColumn("from_stage", F.coalesce("from_stage", F.lit("INIT")))
    allowed = F.lit(False)
    for source, target in STAGE_MOVES:
        allowed = allowed | ((F.col("from_stage") == source) & (F.col("stage") == target))
    return before.withColumn("valid", allowed)
