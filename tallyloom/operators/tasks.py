"""Task documents: context, features, scores and export columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S

# The counts of a task, and the column order of the export.
COUNTS = ["dependent_count", "dependency_count", "subtask_count", "comment_count",
          "follower_count"]
TASK_COLUMNS = [
    "id", "name", "project_data.name", "assignee", "assignee_status", "golden_task_score",
    "impact_score", "engagement_score", "timeliness_recency_score", "is_completed",
    "dependent_count", "dependency_count", "subtask_count", "comment_count", "follower_count",
    "due_date", "last_modified_at", "custom_fields", "url",
]


def merge_details(listed: DataFrame, details: DataFrame, key: str = "gid") -> DataFrame:
    """Detail fields overwrite list fields where given; tasks without details stay as listed."""
    shared = [c for c in listed.columns if c in details.columns and c != key]
    extra = [c for c in details.columns if c not in listed.columns]
    a, b = listed.alias("a"), details.alias("b")
    kept = [c for c in listed.columns if c not in shared and c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(
        F.col(f"a.{key}").alias(key), *[F.col(f"a.{c}") for c in kept],
        *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in shared],
        *[F.col(f"b.{c}") for c in extra])


def with_project(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Attach workspace id and project record; ``projects`` has gid, name, workspace_id."""
    p = projects.select(F.col("gid").alias("project_gid"), "workspace_id",
                        F.struct("gid", "name").alias("project_data"))
    return tasks.join(p, "project_gid")


def comments_only(stories: DataFrame) -> DataFrame:
    return stories.where(F.col("type") == "comment")


def count_comments(stories: DataFrame) -> DataFrame:
    return comments_only(stories).groupBy(F.col("task_gid").alias("gid")).agg(
        F.count(F.lit(1)).alias("comment_count"))


def array_counts(tasks: DataFrame) -> DataFrame:
    """Dependency, dependent and follower counts of nested task documents."""
    return tasks.select(
        "*", S.array_length(F.col("dependents")).alias("dependent_count"),
        S.array_length(F.col("dependencies")).alias("dependency_count"),
        S.array_length(F.col("followers")).alias("follower_count"))


def with_counts(tasks: DataFrame, *counts: DataFrame) -> DataFrame:
    """Left-join count tables keyed by gid; a task missing from one counts zero."""
    for table in counts:
        names = [c for c in table.columns if c != "gid"]
        tasks = tasks.join(table, "gid", "left").fillna(0, names)
    return tasks


def task_features(tasks: DataFrame) -> DataFrame:
    """Identity, status, dates and the counts; the due day wins over the due time."""
    return tasks.select(
        F.coalesce("gid", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("permalink_url", F.lit("")).alias("url"),
        F.coalesce("completed", F.lit(False)).alias("is_completed"),
        F.coalesce(F.nullif("due_on", F.lit("")), "due_at").alias("due_date"),
        F.col("modified_at").alias("last_modified_at"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        *[c for c in ("project_data", "assignee", "assignee_status", "custom_fields")
          if c in tasks.columns])


def urgency(due: Column, as_of) -> Column:
    """1 when overdue, 0.5 when due within 7 whole days (floored), else 0."""
    days = F.floor(-S.elapsed_days(as_of, S.parse_due(due)))
    return F.when(days < 0, 1.0).when(days <= 7, 0.5).otherwise(0.0)


def score_tasks(features: DataFrame, as_of) -> DataFrame:
    """Impact (5), engagement (3) and timeliness (2); completed tasks keep a fifth."""
    def share(count: str) -> Column:
        return S.log_share(F.col(count), F.col(f"_top.{count}"))

    impact = 5 * (0.7 * share("dependent_count") + 0.3 * share("dependency_count"))
    engagement = 3 * (0.5 * share("subtask_count") + 0.3 * share("comment_count")
                      + 0.2 * share("follower_count"))
    idle = F.floor(S.elapsed_days(as_of, S.parse_iso(F.col("last_modified_at"))))
    timeliness = urgency(F.col("due_date"), as_of) + S.decay(idle, 0.02)
    total = F.col("impact_score") + F.col("engagement_score") + F.col("timeliness_recency_score")
    return (S.with_maxima(features, *COUNTS)
            .withColumn("impact_score", impact)
            .withColumn("engagement_score", engagement).drop("_top")
            .withColumn("timeliness_recency_score", timeliness)
            .withColumn("golden_task_score",
                        F.when(F.col("is_completed"), total * 0.2).otherwise(total)))


def ranked_tasks(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("golden_task_score"), F.desc("impact_score"), "id")


def top_tasks(scored: DataFrame, n: int = 5, length: int = 50) -> DataFrame:
    """The best ``n`` tasks with their rank number."""
    # The unpartitioned window only sees the n rows left by the limit.
    order = Window.orderBy(F.desc("golden_task_score"), F.desc("impact_score"), "id")
    return (ranked_tasks(scored).limit(n).withColumn("rank", F.row_number().over(order))
            .withColumn("name", S.shorten(F.col("name"), length)))


def completion_counts(tasks: DataFrame) -> DataFrame:
    done, total = F.count_if("is_completed"), F.count(F.lit(1))
    return tasks.agg(done.alias("completed"), (total - done).alias("incomplete"),
                     S.percentage(done, total).alias("completed_pct"),
                     S.percentage(total - done, total).alias("incomplete_pct"))


def data_quality(tasks: DataFrame) -> DataFrame:
    """Share of tasks with dependencies, dependents, comments and subtasks, in percent."""
    shares = {"dependency_count": "with_dependencies_pct", "dependent_count": "with_dependents_pct",
              "comment_count": "with_comments_pct", "subtask_count": "with_subtasks_pct"}
    total = F.count(F.lit(1))
    return tasks.agg(total.alias("tasks"), *[
        S.percentage(F.count_if(F.col(c) > 0), total).alias(out) for c, out in shares.items()])


def custom_field_text(fields: Column) -> Column:
    """``name: value`` items joined by ``; ``: first of display text, text and number."""
    def value(f: Column) -> Column:
        number = f["number_value"].cast("string")
        return F.coalesce(F.nullif(f["display_value"], F.lit("")),
                          F.nullif(f["text_value"], F.lit("")), number, F.lit("(empty)"))
    items = F.transform(fields, lambda f: F.concat(
        F.coalesce(f["name"], F.lit("Unknown")), F.lit(": "), value(f)))
    return F.coalesce(F.array_join(items, "; "), F.lit(""))


def task_output(scored: DataFrame) -> DataFrame:
    """Export columns: project and assignee lifted out of their structs, fields rendered."""
    ready = (scored
             .withColumn("project_data.name", F.coalesce(F.col("project_data.name"), F.lit("")))
             .withColumn("assignee", F.coalesce(F.col("assignee.name"), F.lit("")))
             .withColumn("assignee_status", F.coalesce("assignee_status", F.lit("")))
             .withColumn("custom_fields", custom_field_text(F.col("custom_fields"))))
    return ready.select([F.col(f"`{c}`") for c in TASK_COLUMNS if c in ready.columns])
