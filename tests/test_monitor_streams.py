import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.operators import lifecycle, metrics, monitor
from tallyloom.sources import scans
from tallyloom.streaming import fanout, followers, runs
from tallyloom.streaming import monitor as live
from tallyloom.streaming.states import StateTable, fold_into

T0 = datetime(2024, 1, 1)


def entry(minute, payload, dag="d", **more):
    base = {"timestamp": (T0 + timedelta(minutes=minute)).isoformat() + "Z", "severity": "INFO",
            "log_name": "projects/p/logs/airflow-worker", "resource_type": "cloud_composer_environment",
            "resource_labels": {"environment_name": "e", "location": "l"}, "dag_id": dag}
    return {**base, **({"text_payload": payload} if isinstance(payload, str) else {"json_payload": payload}), **more}


def mark(minute, state, task="t", dag="d"):
    return entry(minute, f"Marking task as {state}. dag_id={dag}, task_id={task}, run_id=r", dag)


def land(folder, name, rows):
    with open(f"{folder}/{name}.json", "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)


def statuses(spark, folder, batches, max_minutes=30):
    """Run the status stream over one landed file per batch."""
    source, target = f"{folder}/in", f"{folder}/out"
    import os
    os.makedirs(source)
    for i, rows in enumerate(batches):
        land(source, f"b{i}", rows)
        raw = runs.read_stream(spark, source, schemas.RAW_LOG_ENTRIES)
        live.follow_to(monitor.normalise_entries(raw), target, f"{folder}/checkpoint", max_minutes=max_minutes,
                       buckets=4).awaitTermination()
    return sorted(tuple(r) for r in live.run_statuses(spark, target, 4).collect())


def batch_status(spark, rows, folder):
    land(folder, "all", rows)
    logs = monitor.normalise_entries(scans.read_logs(spark, f"{folder}/all.json"))
    states = monitor.task_states(monitor.state_changes(logs))
    return {r.dag_id: r.status for r in monitor.run_status(states).collect()}, states


ROWS = [mark(0, "SUCCESS", dag="ok"), mark(1, "failed", "a", "bad"), mark(2, "SUCCESS", "a", "bad"),
        mark(3, "UP_FOR_RETRY", dag="retry"), mark(4, "SUCCESS", "x", "mixed"), mark(5, "RUNNING", "y", "mixed"),
        entry(6, {"message": "Marking task as FAILED. task_id=z"}, "ok"), entry(7, "Marking task without state", "ok")]


def test_batch_states(spark, folder):
    got, states = batch_status(spark, ROWS, folder)
    assert got == {"ok": "dag_succeeded", "bad": "dag_failed", "retry": "monitoring_timed_out",
                   "mixed": "monitoring_timed_out"}
    last = {(r.dag_id, r.task_id): r.state for r in states.collect()}
    assert last[("bad", "a")] == "SUCCESS" and last[("retry", "t")] == "UP_FOR_RETRY"
    expected = spark.createDataFrame([("ok", "t"), ("ok", "later")], "dag_id string, task_id string")
    assert {r.dag_id: r.status for r in monitor.run_status(states, expected).collect()}["ok"] == "monitoring_timed_out"


def test_last_task_id_of_a_line_counts(spark):
    df = spark.createDataFrame([("d", "Marking task as Success. task_id=a, upstream task_id=b.c-1 done", T0)],
                               "dag_id string, payload string, timestamp timestamp")
    assert tuple(monitor.state_changes(df).first())[:3] == ("d", "b.c-1", "SUCCESS")


def test_stream_equals_batch_when_all_rows_come_at_once(spark, folder):
    end = [entry(200, "later line", "other")]
    got = statuses(spark, folder, [ROWS, end])
    assert [g[:2] for g in got] == [("bad", "dag_failed"), ("mixed", "monitoring_timed_out"), ("ok", "dag_succeeded"),
                                    ("retry", "monitoring_timed_out")]


def test_stream_over_several_batches(spark, folder):
    got = statuses(spark, folder, [
        [mark(0, "RUNNING", "a", "x"), mark(0, "RUNNING", "a", "y"), mark(0, "RUNNING", "a", "z")],
        [mark(1, "SUCCESS", "b", "x"), mark(1, "FAILED", "b", "y")],
        [mark(2, "SUCCESS", "a", "x"), mark(2, "SUCCESS", "a", "y"), mark(3, "SUCCESS", "b", "y")],
        [mark(3, "FAILED", "a", "x")],  # the run is over, the line is ignored
    ])
    assert got == [("x", "dag_succeeded", 2), ("y", "dag_failed", 2)]


def test_states_stream_and_restart(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate([[mark(0, "RUNNING"), mark(0, "FAILED", "u")], [mark(5, "SUCCESS")]]):
        land(f"{folder}/in", f"b{i}", rows)
        raw = runs.read_stream(spark, f"{folder}/in", schemas.RAW_LOG_ENTRIES, files_per_trigger=1)
        states = live.task_states(monitor.normalise_entries(raw))
        runs.update_to(states, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = runs.latest_rows(spark, f"{folder}/out", states.schema, ["dag_id", "task_id"])
    assert sorted((r.task_id, r.state, r.ever_failed) for r in got.collect()) == [
        ("t", "SUCCESS", False), ("u", "FAILED", True)]


def test_monitor_output(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate([ROWS, [mark(8, "SUCCESS", "y", "mixed"), mark(9, "RUNNING", dag="new")]]):
        land(f"{folder}/in", f"b{i}", rows)
        raw = runs.read_stream(spark, f"{folder}/in", schemas.RAW_LOG_ENTRIES)
        query = live.follow_to(monitor.normalise_entries(raw), f"{folder}/out", f"{folder}/cp", keep_logs=True)
        query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out/logs").count() == len(ROWS) + 2
    assert {r.dag_id: r.status for r in live.summary(spark, f"{folder}/out").collect()} == {
        "ok": "dag_succeeded", "bad": "dag_failed", "retry": "monitoring_timed_out", "mixed": "dag_succeeded",
        "new": "monitoring_timed_out"}
    states = live.followed_states(spark, f"{folder}/out")
    assert {(r.dag_id, r.task_id): r.state for r in states.collect()}[("mixed", "y")] == "SUCCESS"
    watched = spark.createDataFrame([("bad",), ("silent",)], "dag_id string")
    emitted = spark.createDataFrame([("bad", "dag_failed", 1)], live.STATUS_SCHEMA)
    assert {r.dag_id: r.status for r in live.run_outcomes(watched, emitted, query).collect()} == {
        "bad": "dag_failed", "silent": "monitoring_timed_out"}


def test_failed_stream_is_a_tool_error(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    land(f"{folder}/in", "a", ROWS)

    def broken(batch, batch_id):
        raise IOError("source went away")
    query = (runs.read_stream(spark, f"{folder}/in", schemas.RAW_LOG_ENTRIES).writeStream.foreachBatch(broken)
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    with pytest.raises(Exception):
        query.awaitTermination()
    watched = spark.createDataFrame([("d",)], "dag_id string")
    none = spark.createDataFrame([], live.STATUS_SCHEMA)
    assert live.run_outcomes(watched, none, query).first().status == "error_in_tool"


def test_log_scan_filters(spark, folder):
    land(folder, "a", [entry(0, "run dag_7"), entry(1, "run dag_7"), entry(2, "other"), entry(3, {"k": "dag_7"}),
                       entry(4, "run dag_7", resource_type="x"), entry(5, "run dag_7", log_name="projects/q/logs/z"),
                       entry(6, "run dag_7", resource_labels={"environment_name": "f", "location": "l"})])
    logs = monitor.normalise_entries(scans.read_logs(spark, folder))
    found = monitor.scan_logs(logs, T0.isoformat(), "cloud_composer_environment", "e", "l",
                              "projects/p/logs/airflow", "dag_7")
    assert [r.timestamp.minute for r in monitor.in_time_order(found).collect()] == [1]
    assert monitor.scan_logs(logs, T0.isoformat()).count() == 6


def test_fan_out_stops_at_the_first_failure(spark, folder):
    batch = spark.createDataFrame([("1", "x"), ("2", "y")], "task_id string, content string")

    def broken(df, batch_id):
        raise IOError("no space")
    first = ("postgres", fanout.parquet_destination(f"{folder}/first"))
    last = ("pubsub", fanout.json_destination(f"{folder}/last"))
    write = fanout.fan_out([first, ("redis", broken), last], f"{folder}/counters")
    with pytest.raises(IOError):
        write(batch, 0)
    counters = spark.read.schema("destination string, rows long").json(f"{folder}/counters")
    assert {r.destination: r.total for r in fanout.success_totals(counters).collect()} == {"postgres": 2}
    fanout.fan_out([first, last], f"{folder}/counters")(batch, 0)  # the retry replaces, it does not add
    counters = spark.read.schema("destination string, rows long").json(f"{folder}/counters")
    assert {r.destination: r.total for r in fanout.success_totals(counters).collect()} == {"postgres": 2, "pubsub": 2}
    assert spark.read.parquet(f"{folder}/first").count() == 2


def test_latest_points(spark):
    rows = [("m", {"k": "a"}, T0, 1.0), ("m", {"k": "a"}, T0 + timedelta(minutes=3), 2.0),
            ("m", {"k": "b"}, T0 - timedelta(minutes=9), 5.0), ("n", {"k": "a"}, T0 + timedelta(minutes=1), 9.0)]
    df = spark.createDataFrame(rows, schemas.METRICS)
    points = metrics.scan_series(df, "2024-01-01T00:04:00", metric="m", labels={"k": "a"})
    assert points.count() == 2
    wanted = spark.createDataFrame([("m",), ("missing",)], "metric string")
    got = {r.metric: r.value for r in metrics.latest_or_zero(wanted, points, ["metric"]).collect()}
    assert got == {"m": 2.0, "missing": 0.0}


def test_exportable_metrics(spark):
    labels = {"customer_id": "1", "user_email": "e", "tenant_id": "t", "project_name": "p", "region": "r"}
    df = spark.createDataFrame([("gcp_cpu", labels, T0, 1.0), ("task_requests_total", labels, T0, 1.0),
                                ("task_requests_total_x", labels, T0, 1.0), ("other", labels, T0, 1.0)], schemas.METRICS)
    got = {r.metric: r.labels for r in metrics.exportable(df).collect()}
    assert got == {"gcp_cpu": {"region": "r"}, "task_requests_total": {"region": "r"}}


def test_progress_events(spark):
    def event(second, **body):
        return ("1", T0 + timedelta(seconds=second), json.dumps(body))
    rows = [event(0, type="stage", stage="PLANNING", status="RUNNING"), event(1, type="context", n=3),
            event(2, type="plan", doc_id="x", version=1), event(3, type="stage", stage="EXECUTING", status="RUNNING:1")]
    rows += [event(10 + i, type="tick", progress=i) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "task_id string, ts timestamp, value string")
    events = lifecycle.parse_events(df)
    assert lifecycle.progress_fold(events).first() == ("1", "EXECUTING", "RUNNING:1", 200, 200, True)
    early = lifecycle.progress_fold(events.where(F.coalesce("progress", F.lit(0)) < 200))
    assert early.first().done is False
    assert lifecycle.of_task(events, "2").count() == 0


def test_stage_checks(spark):
    names = ["PLANNING", "WAIT_RFC", "WAIT_RFC", "EXECUTING", "DONE", "PLANNING"]
    df = spark.createDataFrame([("1", T0 + timedelta(minutes=40 * i), i, s) for i, s in enumerate(names)],
                               "task_id string, ts timestamp, n int, stage string")
    got = lifecycle.checked_stages(df, ["ts", "n"]).orderBy("n").collect()
    assert [r.valid for r in got] == [True] * 5 + [False]
    assert [r.from_stage for r in got][:2] == ["INIT", "PLANNING"]


def test_snapshot_status_and_durations(spark):
    rows = [("1", T0 + timedelta(seconds=i), f, v) for i, (f, v) in enumerate([
        ("state", "queued"), ("created_at", "2024-01-01T00:00:00"), ("started_at", "2024-01-01T00:00:30"),
        ("state", "running"), ("completed_at", "2024-01-01T00:02:00"), ("state", "done"), ("pr_url", "u")])]
    rows += [("2", T0, "state", "failed"), ("3", T0, "state", "done"), ("4", T0, "task_json", '{"engine": "e"}')]
    df = spark.createDataFrame(rows, "task_id string, ts timestamp, field string, value string")
    fields = ["state", "pr_url", "error", "task_json", "created_at", "started_at", "completed_at"]
    snapshot = lifecycle.state_snapshot(df, fields)
    timed = lifecycle.with_durations(snapshot).where("task_id = '1'").first()
    assert (timed.queue_seconds, timed.run_seconds) == (30.0, 90.0)
    got = {r.task_id: (r.state, r.status, r.error, r.engine) for r in lifecycle.status_response(snapshot).collect()}
    assert got == {"1": ("done", "COMPLETED", None, None), "2": ("failed", "FAILED", "Unknown error", None),
                   "3": ("done", "QUEUED", None, None), "4": ("unknown", "QUEUED", None, "e")}


def test_feedback_segments(spark):
    rows = [("d", i, f"b{i}") for i in range(7)] + [("e", 0, "x")]
    df = spark.createDataFrame(rows, "document_id string, n int, body string")
    got = sorted(map(tuple, lifecycle.feedback_text(df, ["n"], F.floor(F.col("n") / 2), size=3).collect()))
    assert got == [("d", 0, "b0 | b1 | b2", 3), ("d", 1, "b3 | b4 | b5", 3), ("d", 2, "b6", 1), ("e", 0, "x", 1)]
    documents = spark.createDataFrame([("e",), ("f",)], "document_id string")
    assert lifecycle.feedback_of(documents, df).count() == 1
    shown = {r.document_id: (r.feedback, r.feedback_count) for r in lifecycle.documents_with_feedback(
        documents, df, ["n"], F.floor(F.col("n") / 2)).collect()}
    assert shown == {"e": ("x", 1), "f": (None, 0)}


def test_users_updates_and_recent_tasks(spark):
    users = spark.createDataFrame([("u1", "a@x")], "id string, email string")
    wanted = spark.createDataFrame([("a@x",), ("b@x",), ("b@x",), (None,), ("",)], "email string")
    got = {r.email: r.id for r in lifecycle.ensure_users(users, wanted).collect()}
    assert got.keys() == {"a@x", "b@x", lifecycle.ANONYMOUS} and got["a@x"] == "u1"
    current = spark.createDataFrame([(1, "old", "k"), (2, "old", "k")], "id int, body string, other string")
    updates = spark.createDataFrame([(2, "new"), (9, "new")], "id int, body string")
    assert sorted(map(tuple, lifecycle.update_rows(current, updates, ["id"]).collect())) == [
        (1, "old", "k"), (2, "new", "k")]
    twice = spark.createDataFrame([(2, "late", 9), (2, "early", 3)], "id int, body string, at int")
    assert sorted(map(tuple, lifecycle.update_rows(current, twice, ["id"], ts="at").collect())) == [
        (1, "old", "k"), (2, "late", "k")]
    cleared = spark.createDataFrame([(2, "mid", 1), (2, None, 2), (1, None, 1), (1, "back", 2)],
                                    "id int, body string, at int")
    assert sorted(map(tuple, lifecycle.update_rows(current, cleared, ["id"], ts="at").collect())) == [
        (1, "back", "k"), (2, None, "k")]
    assert [r.id for r in lifecycle.unmatched_updates(current, updates, ["id"]).collect()] == [9]
    tasks = spark.createDataFrame([(i, "u1", T0 + timedelta(hours=i)) for i in range(60)],
                                  "id int, user_id string, created_at timestamp")
    assert [r.id for r in lifecycle.recent_tasks(tasks, "u1").collect()] == list(range(59, 9, -1))


def test_streaming_followers_match_batch(spark, folder):
    df = spark.createDataFrame([(f"t{i % 3}", T0 + timedelta(seconds=i), f"f{i % 2}", str(i)) for i in range(40)],
                               "task_id string, ts timestamp, field string, value string")
    df.repartition(4).write.parquet(f"{folder}/in")
    stream = runs.read_stream(spark, f"{folder}/in", df.schema, "parquet", files_per_trigger=1)
    start = followers.sink_to(followers.task_snapshot, fields=["f0", "f1"], buckets=4)
    start(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = followers.snapshot_rows(spark, f"{folder}/out", ["f0", "f1"], 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lifecycle.state_snapshot(df, ["f0", "f1"]).collect()))


def test_lines_that_come_late_are_kept_and_counted(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    minutes = [0, 40, 10, 26, 41, 5]
    for i, minute in enumerate(minutes):
        land(f"{folder}/in", f"b{i}", [mark(minute, "RUNNING", f"t{i}"), mark(minute, "RUNNING", f"u{i}")])
        raw = runs.read_stream(spark, f"{folder}/in", schemas.RAW_LOG_ENTRIES)
        live.follow_to(monitor.normalise_entries(raw), f"{folder}/out", f"{folder}/cp", max_minutes=90,
                       buckets=2).awaitTermination()
    late = {r.timestamp.minute for r in spark.read.parquet(f"{folder}/out/late").collect()}
    known = {r.task_id for r in live.followed_states(spark, f"{folder}/out", 2).collect()}
    assert late == {10, 5} and known == {f"{n}{i}" for n in "tu" for i in (0, 1, 3, 4)}
    assert live.line_counts(spark, f"{folder}/out", 2) == {"rows": 12, "late": 4}


def _rows(spark, numbers):
    return spark.createDataFrame([(n, n) for n in numbers], "k int, v int")


def test_state_table_rewrites_only_touched_buckets(spark, folder):
    import os
    table = StateTable(spark, f"{folder}/t", "k int, v int", ["k"], 8)

    def fold(df):
        return df.groupBy("k").agg(F.sum("v").cast("int").alias("v"))
    write = fold_into(lambda session: table, fold, fold)
    write(_rows(spark, range(100)), 0)
    first = table.version()
    write(_rows(spark, [7]), 1)
    second = table.version()
    assert len([k for k in first.files if first.files[k] != second.files[k]]) == 1
    write(_rows(spark, [7]), 1)  # a repeated batch replaces itself
    assert {r.k: r.v for r in table.rows().collect()} == {k: 2 * k if k == 7 else k for k in range(100)}
    write(_rows(spark, []), 2)
    for batch in range(3, 40):
        write(_rows(spark, [batch % 5]), batch)
    assert {r.k: r.v for r in table.rows().collect()}[3] == 3 + 3 * 8
    files = [f for _, _, names in os.walk(f"{folder}/t") for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * 8 and len(os.listdir(f"{folder}/t/versions")) <= 4
    assert len(os.listdir(f"{folder}/t/data")) <= 2 * 8
    with pytest.raises(ValueError):
        StateTable(spark, f"{folder}/t", "k int, v int", ["k"], 4).version()


def test_a_hot_run_is_dealt_over_the_buckets(spark, folder):
    table = live.task_table(spark, folder, 16)
    tasks = spark.range(400).selectExpr("'hot' AS dag_id", "concat('t', id) AS task_id")
    assert len(table.touched(tasks)) == 16
