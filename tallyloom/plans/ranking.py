"""Asset and task ranking end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.functions.staging import stage
from tallyloom.operators import assets, tasks
from tallyloom.operators.hierarchy import subtask_counts


def scored_queries(saved: DataFrame, widgets: DataFrame, as_of) -> DataFrame:
    edges = assets.lineage_edges(widgets)
    return assets.score_queries(assets.query_features(saved, edges), as_of)


def scored_dashboards(dashboards: DataFrame, saved: DataFrame, widgets: DataFrame, as_of) -> DataFrame:
    edges = assets.lineage_edges(widgets)
    scores = stage(scored_queries(saved, widgets, as_of).select("id", "golden_query_score"), "query-scores")
    return assets.score_dashboards(assets.dashboard_features(dashboards), widgets, edges, scores, as_of)


def scored_task_documents(documents: DataFrame, subtask_edges: DataFrame, stories: DataFrame,
                          as_of) -> DataFrame:
    """Nested task documents with hierarchy and comments to scored tasks."""
    counted = tasks.with_counts(tasks.array_counts(documents), subtask_counts(subtask_edges),
                                tasks.count_comments(stories))
    return tasks.score_tasks(tasks.task_features(counted), as_of)
