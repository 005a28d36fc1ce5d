"""Registered queries: each operator run over the whole driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import predicates as P
from tallyloom.functions.grouped import distinct_counts
from tallyloom.functions.scalars import with_maxima
from tallyloom.functions.sqlfunctions import register_functions
from tallyloom.functions.sqltext import is_date_text
from tallyloom.functions.staging import new_path, stage
from tallyloom.operators import (assets, catalog, features, hierarchy, inventory, lifecycle, metrics,
                                 monitor, querylog, repos, signatures, tasks)
from tallyloom.plans import adapters as A
from tallyloom.plans import mining, ranking
from tallyloom.plans.adapters import EVENTS_AS_OF, ORDERS_AS_OF, Tables
from tallyloom.sources import scans, sinks
from tallyloom.streaming import followers, runs
from tallyloom.streaming.serving import ServingTable
from tallyloom.streaming import monitor as live_monitor

QUERIES = {}


def registered(function):
    def run(spark, sf_dir):
        return function(Tables(spark, sf_dir))
    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


# ---- BI assets ----------------------------------------------------------------------


@registered
def asset_downstream_counts(t):
    return assets.query_features(A.saved_queries(t), assets.lineage_edges(A.widgets(t))).select(
        "id", "user_name", "downstream_dashboard_count", "downstream_chart_count")


@registered
def golden_query_score(t):
    scored = ranking.scored_queries(A.saved_queries(t), A.widgets(t), ORDERS_AS_OF)
    return assets.ranked_queries(scored).select(
        "id", "name", *_r("impact_score", "recency_score", "curation_score", "golden_query_score"))


@registered
def golden_dashboard_score(t):
    scored = ranking.scored_dashboards(A.dashboards(t), A.saved_queries(t), A.widgets(t), ORDERS_AS_OF)
    return assets.ranked_dashboards(scored).select(
        "id", "user_name", "is_draft", *_r("content_quality_score", "recency_score",
                                           "curation_score", "golden_dashboard_score"))


@registered
def top_golden_queries(t):
    scored = ranking.scored_queries(A.saved_queries(t), A.widgets(t), ORDERS_AS_OF)
    return assets.top_queries(scored).select("id", "name", *_r("golden_query_score"))


@registered
def top_golden_dashboards(t):
    scored = ranking.scored_dashboards(A.dashboards(t), A.saved_queries(t), A.widgets(t), ORDERS_AS_OF)
    return assets.top_dashboards(scored).select(
        "id", "name", "is_draft", "query_count", *_r("golden_dashboard_score"))


@registered
def query_score_stats(t):
    scored = ranking.scored_queries(A.saved_queries(t), A.widgets(t), ORDERS_AS_OF)
    return assets.score_distribution(scored, "impact_score", "recency_score", "golden_query_score"
                                     ).select("score", *_r("lowest", "highest", "average"))


@registered
def widget_type_stats(t):
    return assets.widget_statistics(A.widgets(t))


@registered
def chart_edges_counting_mode(t):
    """Edges per dashboard under the counting rule for widget types."""
    edges = assets.lineage_edges(A.widgets(t), mode="counting")
    return edges.groupBy("dashboard_id").agg(F.count(F.lit(1)).alias("edges"))


@registered
def accessible_widgets(t):
    edges = assets.lineage_edges(A.widgets(t), mode="counting")
    return assets.accessible_widgets(edges, A.fetched_queries(t)).select("widget_id", "query_id")


@registered
def orphan_edges(t):
    return assets.orphan_queries(assets.lineage_edges(A.widgets(t)), A.fetched_queries(t))


@registered
def lineage_summary(t):
    return assets.lineage_summary(assets.lineage_edges(A.widgets(t)))


@registered
def dashboard_query_counts(t):
    """Every listed dashboard with the number of queries it uses."""
    used = assets.queries_per_dashboard(assets.lineage_edges(A.widgets(t)))
    listed = assets.dashboard_features(A.dashboards(t)).select("id", "is_draft")
    return listed.join(used.withColumnRenamed("dashboard_id", "id"), "id", "left").fillna(
        0, ["query_count"])


@registered
def asset_counts(t):
    edges = assets.lineage_edges(A.widgets(t), mode="counting")
    return assets.asset_counts(A.dashboards(t), assets.accessible_widgets(edges, A.fetched_queries(t)),
                               A.saved_queries(t))


@registered
def phase_summary(t):
    """Listed, fetched and failed items of one extraction phase."""
    listed, details = A.saved_queries(t), A.fetched_queries(t)
    return sinks.phase_summary({
        "queries_listed": listed, "queries_fetched": scans.fetched(listed, details),
        "queries_failed": scans.not_fetched(listed, details), "dashboards": A.dashboards(t)})


# ---- query log ----------------------------------------------------------------------


def _shaped(t, staged=False):
    return mining.shaped_jobs(A.jobs(t), staged=staged)


@registered
def query_shapes(t):
    return querylog.shape_profile(querylog.usage_facts(_shaped(t))).select(
        "query_shape_id", "normalized_sql", "total_execution_count", "distinct_user_count",
        _time("last_execution_timestamp"))


@registered
def query_shapes_masked_once(t):
    """Shapes by way of the distinct texts."""
    shaped = mining.shaped_jobs(A.jobs(t), mask_once=True, staged=False)
    return shaped.groupBy("query_shape_id").agg(F.count(F.lit(1)).alias("executions"))


@registered
def query_structure(t):
    shapes = _shaped(t).select("query_shape_id", "normalized_sql").distinct()
    return querylog.with_complexity(querylog.with_structure(shapes)).select(
        "query_shape_id", "join_count", "cte_count", "window_function_count", "subquery_count",
        "aggregation_presence", "raw_complexity_score", *_r("complexity_score"))


@registered
def query_regularity(t):
    stats = querylog.shape_regularity(_shaped(t))
    return stats.select("query_shape_id", "is_single_execution",
                        F.round("execution_regularity_stdev", 4).alias("execution_regularity_stdev"))


@registered
def query_ownership(t):
    return querylog.shape_profile(querylog.usage_facts(_shaped(t))).select(
        "query_shape_id", "creator_first_seen_user", "primary_user_most_frequent_executor",
        "statement_type", "is_service_account", "is_dml")


@registered
def query_lineage(t):
    facts = querylog.usage_facts(_shaped(t))
    profile = querylog.shape_profile(facts).select(
        "query_shape_id", "destination_table", "is_temporary_write", "has_persistent_destination")
    return querylog.shape_sources(facts).join(profile, "query_shape_id")


@registered
def golden_query_features(t):
    table = mining.golden_query_features(A.jobs(t), EVENTS_AS_OF)
    return table.select(
        *[c for c in querylog.FEATURE_COLUMNS if c in table.columns and c not in (
            "last_execution_timestamp", "execution_regularity_stdev", "complexity_score",
            "hours_since_last_run", "regularity_hours")],
        "is_single_execution", _time("last_execution_timestamp"),
        F.round("execution_regularity_stdev", 4).alias("execution_regularity_stdev"),
        *_r("complexity_score", "hours_since_last_run"),
        # Text with two decimals: compared as a number to one, off the edges of rounding.
        F.when(F.col("is_single_execution"), F.col("regularity_hours")).otherwise(
            F.floor(F.col("regularity_hours").try_cast("double") * 10 + 0.01).cast("string"))
        .alias("regularity_tenths"))


@registered
def query_history(t):
    """Run times per shape as ascending lists, long lists in segments."""
    parts = querylog.history_segments(_shaped(t, staged=True), size=100)
    return parts.select("query_shape_id", "segment", _joined("full_execution_history"))


@registered
def query_shape_users(t):
    return querylog.shape_users(querylog.usage_facts(_shaped(t))).select(
        "query_shape_id", "user_email", "runs", _time("first_run"))


@registered
def query_export(t):
    """Feature rows with their lists, in export form."""
    shaped = _shaped(t, staged=True)
    whole = querylog.with_lists(querylog.query_features(shaped, EVENTS_AS_OF), shaped)
    export = querylog.feature_export(whole)
    return export.select(
        "query_shape_id", F.array_join(F.sort_array("list_of_distinct_users"), ",").alias("users"),
        F.array_join(F.sort_array("source_tables"), ",").alias("sources"),
        F.array_join("full_execution_history", ",").alias("history"), "total_execution_count")


@registered
def finished_jobs(t):
    """Finished query jobs of the last 20 days."""
    as_of = datetime.fromisoformat(EVENTS_AS_OF)
    return scans.finished_queries(A.jobs(t), "p", as_of, days_back=20).select(
        "job_id", "region", "user_email", _time("start_time"))


@registered
def top_raw_queries(t):
    return querylog.top_raw_queries(A.jobs(t))


@registered
def query_previews(t):
    return querylog.query_previews(A.jobs(t))


@registered
def candidate_jobs(t):
    return querylog.candidate_jobs(A.jobs(t)).select("job_id", "user_email", "query")


@registered
def coverage_reduction(t):
    return querylog.coverage_reduction(_shaped(t)).select("jobs", "shapes", *_r("reduction_pct"))


@registered
def query_signatures(t):
    signed = signatures.with_signature(A.jobs(t).select("job_id", "query"))
    return signed.select(
        "job_id", *[_joined(c) for c in ("leaf_tables", "join_edges", "agg_funcs", "set_ops")],
        "has_limit", "has_order_by", "date_window")


@registered
def signature_diff(t):
    diff = signatures.diff_pairs(A.query_pairs(t), "event_id")
    return diff.select("event_id", "text_equal", "shape_equal", "signature_equal",
                       _joined("changed_parts"), "tokens_removed", "tokens_added")


@registered
def signature_comparison(t):
    """Signature tables of both texts compared by key."""
    pairs = A.query_pairs(t)
    left = signatures.with_signature(pairs.select("event_id", F.col("left_query").alias("query")))
    right = signatures.with_signature(pairs.select("event_id", F.col("right_query").alias("query")))
    compared = signatures.compare_signatures(left, right, "event_id")
    return compared.select(
        "event_id", "signature_equal",
        F.array_join(F.sort_array(F.map_keys("delta")), ",").alias("changed_parts"))


@registered
def date_window_intersection(t):
    return signatures.with_date_window(A.jobs(t).select("job_id", "query")).drop("query")


# ---- warehouse inventory ------------------------------------------------------------


@registered
def logical_tables(t):
    return inventory.logical_tables(A.physical_tables(t), by_dataset=True)


@registered
def unique_queries_by_region(t):
    return inventory.unique_queries_by_region(A.jobs(t))


@registered
def sketched_unique_queries(t):
    """Unique queries of each region from stored daily sketches, held against the exact count."""
    days = stage(inventory.query_sketches(A.jobs(t)), "sketches")
    exact = inventory.unique_queries_by_region(A.jobs(t))
    off = F.abs(F.col("estimate") - F.col("unique_queries"))
    return inventory.unique_from_sketches(days).withColumnRenamed("unique_queries", "estimate").join(
        exact, "region").select("region", "unique_queries",
                                (off <= F.greatest(F.lit(2.0), 0.05 * F.col("unique_queries"))).alias("near"))


@registered
def inventory_counts(t):
    return inventory.inventory_counts(A.datasets(t), A.physical_tables(t), A.jobs(t))


@registered
def unique_queries_overall(t):
    return inventory.unique_query_count(A.jobs(t), global_distinct=True)


@registered
def region_datasets(t):
    return inventory.region_datasets(A.datasets(t)).select("region", _joined("datasets"))


@registered
def tables_in_datasets(t):
    listed = A.datasets(t).where(F.col("location") == "EU")
    return inventory.tables_of_datasets(A.physical_tables(t), listed).select(
        "region", "table_schema", "table_name")


# ---- tasks --------------------------------------------------------------------------


def _task_counts(t):
    links = A.task_links(t)
    distinct = distinct_counts(links, ["gid"], {
        "dependent_count": "dependent", "dependency_count": "dependency",
        "follower_count": "follower"})
    rows = links.groupBy("gid").agg(F.count_if("is_subtask").alias("subtask_count"))
    comments = tasks.count_comments(links.withColumnRenamed("gid", "task_gid"))
    return distinct, rows, comments


def _task_features(t):
    return tasks.task_features(tasks.with_counts(A.tasks(t), *_task_counts(t)))


def _scored_tasks(t):
    # Staged, so that the dataset maxima do not take the counts a second time.
    return tasks.score_tasks(stage(_task_features(t), "task-features"), ORDERS_AS_OF)


@registered
def task_features(t):
    return _task_features(t).select("id", "url", "is_completed", "due_date", "last_modified_at",
                                    *tasks.COUNTS)


@registered
def golden_task_score(t):
    return tasks.ranked_tasks(_scored_tasks(t)).select(
        "id", *_r("impact_score", "engagement_score", "timeliness_recency_score",
                  "golden_task_score"))


@registered
def top_golden_tasks(t):
    return tasks.top_tasks(_scored_tasks(t)).select("rank", "id", "name", *_r("golden_task_score"))


@registered
def task_score_stats(t):
    return assets.score_distribution(
        _scored_tasks(t), "golden_task_score", "impact_score", "engagement_score",
        "timeliness_recency_score").select("score", *_r("lowest", "highest", "average"))


@registered
def task_completion(t):
    return tasks.completion_counts(_task_features(t))


@registered
def task_quality(t):
    return tasks.data_quality(_task_features(t))


@registered
def task_output(t):
    # None of the counts and scores is shown, so none is taken.
    unscored = A.tasks(t).select("*", *[F.lit(0).alias(c) for c in tasks.COUNTS])
    out = tasks.task_output(tasks.task_features(unscored))
    return out.select("id", F.col("`project_data.name`").alias("project_name"), "assignee",
                      "assignee_status", "custom_fields")


@registered
def task_details_merged(t):
    listed = t.orders.select(F.col("o_orderkey").alias("gid"), F.col("o_orderstatus").alias("name"),
                             F.col("o_orderpriority").alias("assignee"))
    details = t.orders.where(F.col("o_totalprice") > 250_000).select(
        F.col("o_orderkey").alias("gid"), F.concat(F.lit("D-"), F.col("o_orderstatus")).alias("name"),
        F.col("o_custkey").alias("project_gid"))
    return tasks.merge_details(listed, details)


@registered
def task_projects(t):
    projects = t.customer.select(
        F.col("c_custkey").alias("gid"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("workspace_id"))
    listed = A.tasks(t).select("gid", "project_gid")
    return tasks.with_project(listed, projects).select(
        "gid", "workspace_id", F.col("project_data.name").alias("project_name"))


@registered
def subtask_closure(t):
    return hierarchy.subtask_closure(A.subtasks(t))


@registered
def subtask_counts(t):
    return hierarchy.subtask_counts(A.subtasks(t))


# ---- repositories -------------------------------------------------------------------


def _repo_metrics(t):
    return repos.repo_metrics(A.repos(t), A.repo_files(t), A.pull_requests(t), A.commits(t))


@registered
def repo_metrics(t):
    return _repo_metrics(t).select("org", "repo", *repos.COUNTS)


@registered
def repo_totals(t):
    return repos.repo_totals(_repo_metrics(t))


@registered
def repo_summary(t):
    return repos.organisation_summary(_repo_metrics(t))


@registered
def repo_active_share(t):
    return repos.active_share(_repo_metrics(t))


@registered
def repo_activity_rank(t):
    return repos.by_activity(_repo_metrics(t)).select(
        "org", "repo", "activity")


@registered
def text_file_ratio(t):
    """Documents and pages that pass the text test, per kind."""
    docs = t.documents.select(F.lit("documents").alias("kind"), F.col("text").alias("body"))
    pages = t.pages.select(F.lit("pages").alias("kind"), F.col("html").alias("body"))
    texty = P.looks_like_text(F.encode("body", "UTF-8"))
    return docs.unionByName(pages).groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(texty).alias("text_files"))


# ---- BI catalog ---------------------------------------------------------------------


@registered
def card_type_counts(t):
    return catalog.card_counts(A.cards(t))


@registered
def card_samples(t):
    sample = catalog.sample_cards(A.cards(t), ["id"], 5)
    return catalog.dump_lines(sample, "list", F.struct("id", "type", "name")).select(
        "artifact", "kind", "id", F.get_json_object("data", "$.name").alias("name"))


@registered
def card_result_samples(t):
    sample = catalog.sample_result_rows(
        A.card_rows(t), ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    values = catalog.row_as_map(F.array(F.lit("order"), F.lit("line"), F.lit("missing")), F.col("row"))
    return sample.select("card_id", F.col("row_number").cast("long").alias("row_number"),
                         "row_count_sampled", values["order"].alias("order_text"),
                         values["line"].alias("line_text"), values["missing"].alias("missing"))


@registered
def artifact_counts(t):
    return catalog.artifact_counts(
        collections=t.nation, dashboards=A.dashboards(t), segments=t.supplier, snippets=t.benchmark)


# ---- workflow logs ------------------------------------------------------------------


@registered
def dag_task_states(t):
    return monitor.task_states(monitor.state_changes(A.dag_logs(t)))


@registered
def dag_status(t):
    return monitor.run_status(monitor.task_states(monitor.state_changes(A.dag_logs(t))))


@registered
def dag_log_scan(t):
    found = monitor.scan_logs(A.dag_logs(t), "2024-01-15 12:00:00", "cloud_composer_environment",
                              environment="env1", location="eu", log_name="projects/p/logs/airflow",
                              dag_id="dag_1")
    return found.select(_time("timestamp"), "dag_id", "payload")


def _streamed_tables(t, name, project):
    """Adapter over a driver table read as a stream."""
    schema = getattr(t, name).schema
    # Exactly this table, as a pattern: a stream takes a single file only by one.
    files = t.spark.readStream.schema(schema).format("parquet").load(f"{t.folder}/{name}.parque[t]")
    streamed = Tables(t.spark, t.folder)
    streamed.__dict__[name] = files
    return project(streamed)


@registered
def dag_status_stream(t):
    """Outcome of every run, followed as a stream over what has landed."""
    path = runs.run_now(_streamed_tables(t, "events", A.dag_logs), live_monitor.follow_to, "dag-status")
    return live_monitor.run_outcomes(monitor.state_changes(A.dag_logs(t)),
                                     live_monitor.run_statuses(t.spark, path))


@registered
def monitor_summary_stream(t):
    """Tasks and status of every run, as the monitor's tables have them."""
    path = runs.run_now(_streamed_tables(t, "events", A.dag_logs), live_monitor.follow_to, "monitor")
    return live_monitor.summary(t.spark, path)


@registered
def dag_task_states_stream(t):
    start = followers.sink_to(live_monitor.follow_runs, look_back=None)
    path = runs.run_now(_streamed_tables(t, "events", A.dag_logs), start, "dag-task-states")
    return live_monitor.followed_states(t.spark, path).drop("timestamp")


# ---- metrics ------------------------------------------------------------------------


def _labelled(t):
    return A.metrics(t).select("metric", F.col("labels")["region"].alias("region"), "ts", "value")


@registered
def latest_metric_5m(t):
    """Latest value of every series within five minutes of a moment, 0 where there is none."""
    points = metrics.scan_series(_labelled(t), "2024-01-20 12:00:00")
    return metrics.latest_or_zero(_labelled(t), points, ["metric", "region"])


@registered
def latest_metric_windows(t):
    windows = metrics.latest_per_window(_labelled(t), ["metric", "region"])
    return windows.select(_time("window_start"), "metric", "region", "value")


@registered
def latest_metric_stream(t):
    """Window results as they stand once all landed points are read."""
    stream = followers.latest_metrics(_streamed_tables(t, "events", _labelled), ["metric", "region"])
    path = runs.run_now(stream, runs.update_to, "latest-metrics")
    done = runs.latest_rows(t.spark, path, stream.schema, ["window_start", "metric", "region"])
    return done.select(_time("window_start"), "metric", "region", "value")


@registered
def metric_sanitise(t):
    kept = metrics.exportable(A.metrics(t))
    labels = F.array_join(F.sort_array(F.transform(
        F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return kept.select("metric", labels.alias("labels"), _time("ts"), "value")


@registered
def counter_totals(t):
    return metrics.counter_totals(t.events.select(F.col("event_type").alias("counter")))


@registered
def counter_totals_stream(t):
    stream = followers.counter_totals(_streamed_tables(
        t, "events", lambda s: s.events.select(F.col("event_type").alias("counter"))))
    path = runs.run_now(stream, runs.update_to, "counters")
    return runs.latest_rows(t.spark, path, stream.schema, ["counter"])


# ---- task, document and feedback state ----------------------------------------------

HASH_FIELDS = ["state", "pr_url", "error", "task_json", "started_at"]


@registered
def task_state_snapshot(t):
    return lifecycle.state_snapshot(A.task_hash_events(t), HASH_FIELDS)


@registered
def task_status_labels(t):
    return lifecycle.status_response(
        lifecycle.state_snapshot(A.task_hash_events(t), HASH_FIELDS)).select(
        "task_id", "state", "status", "pr_url", "error", "engine", "started_at")


@registered
def task_snapshot_stream(t):
    start = followers.sink_to(followers.task_snapshot, fields=HASH_FIELDS, id_type="bigint")
    path = runs.run_now(_streamed_tables(t, "events", A.task_hash_events), start, "task-snapshot")
    return followers.snapshot_rows(t.spark, path, HASH_FIELDS, id_type="bigint")


@registered
def task_stage_checks(t):
    checked = lifecycle.checked_stages(A.stage_events(t), ["ts", "event_id"])
    return checked.select("event_id", "task_id", "from_stage", "stage", "valid")


@registered
def task_progress(t):
    return lifecycle.progress_fold(lifecycle.parse_events(A.progress_json(t)))


@registered
def task_progress_stream(t):
    start = followers.sink_to(followers.task_progress, id_type="bigint")
    path = runs.run_now(_streamed_tables(t, "events", A.progress_json), start, "task-progress")
    return followers.progress_rows(t.spark, path, id_type="bigint")


@registered
def user_recent_tasks(t):
    rows = t.events.select(F.col("event_id").alias("id"), "user_id",
                           F.col("ts").cast("timestamp").alias("created_at"))
    return lifecycle.recent_tasks_per_user(rows).select(
        "user_id", "id", F.col("position").cast("long").alias("position"))


@registered
def tasks_of_users(t):
    users = t.customer.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"))
    rows = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"))
    return lifecycle.tasks_of_users(users, rows)


@registered
def users_ensured(t):
    """Known and newly added users."""
    known = t.customer.where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").cast("string").alias("id"), F.lower("c_name").alias("email"))
    wanted = t.customer.select(
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_name")).alias("email"), "c_custkey")
    everyone = lifecycle.ensure_users(known, wanted, request="c_custkey")
    return everyone.select("email", (F.length("id") < 36).alias("was_known"))


@registered
def feedback_concat(t):
    """Feedback text per document, including documents without feedback."""
    rows = A.feedback(t)
    documents = t.documents.select(F.col("doc_id").alias("document_id")).union(
        rows.select("document_id")).distinct()
    return lifecycle.documents_with_feedback(documents, rows, ["turn"],
                                             F.floor(F.col("turn") / 64))


@registered
def latest_document(t):
    return lifecycle.latest_documents(A.task_documents(t), carried=("kind", "body"))


@registered
def document_locks(t):
    """Labelled documents come under review, then those of good quality become LOCKED, and toxic ones
    lose their status; the others stay drafts."""
    current = t.documents.select("doc_id", F.lit("DRAFT").alias("status"), "lang")
    review = t.labels.select("doc_id", F.lit("REVIEW").alias("status"), F.lit(1).alias("at"))
    locks = t.labels.where(F.col("quality") == 1).select(
        "doc_id", F.lit("LOCKED").alias("status"), F.lit(2).alias("at"))
    cleared = t.labels.where(F.col("toxic") == 1).select(
        "doc_id", F.lit(None).cast("string").alias("status"), F.lit(3).alias("at"))
    updates = locks.unionByName(review).unionByName(cleared)
    return lifecycle.update_rows(current, updates, ["doc_id"], ts="at")


@registered
def unmatched_updates(t):
    """Status updates for documents that have no label row."""
    updates = t.documents.select("doc_id", "source")
    return lifecycle.unmatched_updates(t.labels, updates, ["doc_id"])


@registered
def folded_updates(t):
    """Current role and text per conversation of its append-only turns."""
    return lifecycle.fold_updates(t.conversations, ["conv_id"], ["role", "text"], ts="turn")


# ---- feature tables -----------------------------------------------------------------


def _groups(t):
    activity = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("ts").cast("timestamp").alias("last_ts"))
    activity = activity.join(features.distinct_event_types(t.events), "user_id")
    spending = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("o_totalprice").alias("total"))
    return (features.FeatureGroup("activity", activity, ("user_id",)),
            features.FeatureGroup("spending", spending, ("o_custkey",)))


def _view(t):
    return features.feature_view(list(_groups(t)), [["distinct_event_types", "event_count"],
                                                    ["order_count", "total"]])


@registered
def feature_view(t):
    return _view(t).select("entity_id", "distinct_event_types", "event_count", "order_count",
                           F.round("total", 2).alias("total"))


@registered
def feature_view_of_pairs(t):
    """Entities of two id columns, with the joiner inside of either."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    left = t.lineitem.groupBy(F.concat(flag, F.lit("|")).alias("a"), status.alias("b")).agg(
        F.count(F.lit(1)).alias("lines"))
    right = t.lineitem.groupBy(flag.alias("a"), F.concat(F.lit("|"), status).alias("b")).agg(
        F.countDistinct("l_suppkey").alias("suppliers"))
    groups = [features.FeatureGroup("x", left, ("a", "b")), features.FeatureGroup("y", right, ("a", "b"))]
    return features.feature_view(groups, [["lines"], ["suppliers"]])


@registered
def feature_lookup(t):
    wanted = t.supplier.select(F.col("s_suppkey").alias("entity_id")).unionByName(
        t.part.select(F.col("p_partkey").alias("entity_id")))
    return features.lookup(_view(t), wanted).select(
        "entity_id", "found", "event_count", "order_count")


@registered
def feature_key_check(t):
    group = features.FeatureGroup("lines", t.lineitem, ("l_orderkey", "l_linenumber"))
    return features.duplicate_entities(group)


@registered
def distinct_event_types(t):
    return features.distinct_event_types(t.events)


# ---- landed files: written by a sink, read back by a source ---------------------------


@registered
def landed_jobs(t):
    """Jobs landed by region and read again."""
    path = new_path(t.spark, "jobs")
    A.jobs(t).write.partitionBy("region").parquet(path)
    return scans.read_jobs(t.spark, path).select("job_id", "region", "state", _time("creation_time"))


@registered
def landed_documents(t):
    """Dashboards written as JSON records and read with their schema."""
    path = new_path(t.spark, "dashboards")
    sinks.write_records(A.dashboards(t), path)
    found = scans.read_documents(t.spark, path, schemas.DASHBOARDS)
    return found.select("id", "slug", F.col("created_by.name").alias("author"), "is_draft")


@registered
def exported_records(t):
    """Events as JSON records, read back."""
    path = new_path(t.spark, "records")
    sinks.write_records(t.events.select("event_id", "event_type", "value"), path)
    return t.spark.read.schema("event_id long, event_type string, value double").json(path)


@registered
def exported_csv(t):
    """Saved queries as quoted CSV in export order, read back."""
    path = new_path(t.spark, "csv")
    sinks.write_csv(A.saved_queries(t), path, ["id", "name", "schedule", "description", "absent"])
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@registered
def dumped_cards(t):
    """Cards dumped by artifact and read back."""
    path = new_path(t.spark, "dump")
    cards = A.cards(t).withColumn("artifact", P.card_kind(F.coalesce("type", F.lit(""))))
    sinks.write_dump(catalog.dump_lines(cards, "list", F.struct("id", "name")), path)
    found = t.spark.read.schema(schemas.DUMP_LINE).json(path)
    return found.select("artifact", "kind", "id", F.get_json_object("data", "$.name").alias("name"))


@registered
def served_features(t):
    """The feature view as a serving table."""
    path = new_path(t.spark, "serving")
    features.materialise(_view(t), path)
    return t.spark.read.parquet(path).select("entity_id", "event_count", "order_count")


@registered
def landed_log(t):
    """Events landed by day, type and user, read again in two intervals that meet inside a day."""
    path, middle = new_path(t.spark, "landed"), "2024-01-16 12:00:00"
    log = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    sinks.write_landed(log, path, "ts", ["event_type", "user_id"], ["event_id"])
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    first = scans.read_landed(t.spark, path, schema, "ts", until=middle)
    second = scans.read_landed(t.spark, path, schema, "ts", start=middle)
    return first.withColumn("half", F.lit(1)).unionByName(second.withColumn("half", F.lit(2))).select(
        "event_id", "user_id", "event_type", _time("ts"), "half")


@registered
def refreshed_features(t):
    """The feature view, kept up to date: the first half of the time, then only who has changed."""
    middle = t.events.agg(F.expr("timestamp_micros((min(unix_micros(cast(ts as timestamp))) "
                                 "+ max(unix_micros(cast(ts as timestamp)))) div 2)")).scalar()

    def activity(events):
        return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_ts"))

    spending = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("order_count"), F.max("o_orderdate").alias("last_order"))
    late = t.events.where(F.col("ts") > middle)
    changed = t.events.join(late.select("user_id").distinct(), "user_id", "left_semi")
    early = activity(t.events.where(F.col("ts") <= middle))
    served = ServingTable(t.spark, new_path(t.spark, "serving"),
                          [features.FeatureGroup("activity", early, ("user_id",), "last_ts"),
                           features.FeatureGroup("spending", spending, ("o_custkey",), "last_order")],
                          [["event_count"], ["order_count"]], buckets=16)
    served.refresh({"activity": early, "spending": spending})
    served.refresh({"activity": activity(changed)})
    return served.view()


@registered
def log_lines_in_order(t):
    lines = monitor.in_time_order(A.dag_logs(t))
    return lines.select(_time("timestamp"), "dag_id", "payload")


@registered
def regions_together(t):
    """Jobs of three regions read one by one."""
    found = scans.all_regions(*[A.jobs(t).where(F.col("region") == f"r{k}") for k in range(3)])
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("jobs"))


@registered
def named_repositories(t):
    """Repositories by slug, name or full name; nameless ones are left out."""
    key = F.col("s_suppkey")
    listed = t.supplier.select(
        F.col("s_nationkey").cast("string").alias("org"),
        F.when(key % 3 == 0, F.concat(F.lit("slug-"), key)).alias("slug"),
        F.when(key % 2 == 0, F.col("s_name")).otherwise("").alias("name"),
        F.when(key % 5 != 0, F.concat(F.lit("org/repo-"), key)).alias("full_name"),
        F.lit("https://git.example/").alias("html_url"), F.lit(None).cast("long").alias("size"),
        *[F.lit(None).cast("boolean").alias(c) for c in ("fork", "private", "archived")],
        F.lit("").alias("default_branch"))
    valid = repos.valid_repositories(listed).select("full_name", F.lit(True).alias("valid"))
    return repos.repositories(listed).select("org", "repo", "full_name", "size", "default_branch").join(
        valid, "full_name", "left").fillna(False, ["valid"])


@registered
def page_extensions(t):
    """Pages per ending of their URL path."""
    path = F.concat(F.substring_index("url", "?", 1), F.when(F.col("page_id") % 2 == 0, ".html.gz").otherwise(".JSON"))
    return t.pages.groupBy(P.file_extension(path).alias("extension")).agg(F.count(F.lit(1)).alias("pages"))


@registered
def date_texts(t):
    """Order dates in several spellings, and which of them are date literals."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T")))
             .when(F.col("o_orderkey") % 2 == 0, F.replace(day, F.lit("-"), F.lit("/"))))
    return t.orders.select("o_orderkey", is_date_text(text).alias("is_date"))


@registered
def running_progress(t):
    """Progress numbers of status texts."""
    status = F.when(F.col("event_type") == "view", "RUNNING").when(
        F.col("event_type") == "error", "RUNNING:x").otherwise(
        F.concat(F.lit("RUNNING:"), F.col("event_id") % 100))
    return t.events.select("event_id", P.progress_of(status).alias("progress"))


@registered
def events_of_a_task(t):
    events = lifecycle.of_task(lifecycle.parse_events(A.progress_json(t)), 7)
    return events.select(_time("ts"), "type", "stage", "progress")


# ---- SQL surface --------------------------------------------------------------------


def _sql(t, text, **tables):
    if not t.spark.catalog.functionExists("signature_parts"):
        register_functions(t.spark)
    return t.spark.sql(text, **tables)


@registered
def widgets_in_sql(t):
    """Widgets of nested dashboard documents, by the SQL table function."""
    return _sql(t, """SELECT w.dashboard_id, w.pos, w.widget_id, w.query_id, w.text, w.row, w.col,
        widget_kind(w.has_visualization, w.viz_type) AS kind
        FROM {dashboards} d, LATERAL dashboard_widgets(d.id, d.widgets) w""", dashboards=A.nested_dashboards(t))


@registered
def result_rows_in_sql(t):
    """First rows of every card's result by name, by the SQL table function."""
    return _sql(t, """SELECT c.card_id, r.row_number, r.fields['part'] AS part_text, r.fields['line'] AS line_text,
        r.fields['missing'] AS missing, cardinality(r.fields) AS n_fields
        FROM {cards} c, LATERAL result_rows(c.cols, c.rows, 3) r""", cards=A.nested_results(t))


@registered
def signature_parts_in_sql(t):
    return _sql(t, "SELECT j.job_id, s.part, s.value FROM {jobs} j, LATERAL signature_parts(j.query) s",
                jobs=A.jobs(t).select("job_id", "query"))


@registered
def query_scores_in_sql(t):
    """The score parts of saved queries, written in SQL."""
    counted = assets.query_features(A.saved_queries(t), assets.lineage_edges(A.widgets(t)))
    counted = with_maxima(counted, "downstream_dashboard_count", "downstream_chart_count")
    scored = _sql(t, """SELECT id, query_impact(downstream_dashboard_count, downstream_chart_count,
            _top.downstream_dashboard_count, _top.downstream_chart_count) AS impact_score,
          query_recency(to_timestamp({as_of}), updated_at) AS recency_score,
          query_curation(description, schedule) AS curation_score FROM {counted}""",
                  counted=counted, as_of=ORDERS_AS_OF)
    return scored.select("id", *_r("impact_score", "recency_score", "curation_score"))
