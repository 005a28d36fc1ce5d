"""BI asset lineage and scoring: widgets, edges, saved queries, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.functions.grouped import distinct_counts
from tallyloom.functions.predicates import person_name

NO_VISUALIZATION = "no_visualization"
WHITESPACE = " \t\n\r\x0b\x0c"

# Column orders of the two exports.
QUERY_COLUMNS = [
    "id", "name", "golden_query_score", "impact_score", "recency_score", "curation_score",
    "downstream_dashboard_count", "downstream_chart_count", "user_name", "last_executed_at",
    "created_at", "query",
]
DASHBOARD_COLUMNS = [
    "id", "name", "golden_dashboard_score", "content_quality_score", "recency_score",
    "curation_score", "user_name", "updated_at", "created_at", "slug",
]


def flatten_widgets(dashboards: DataFrame) -> DataFrame:
    """One row per widget of the nested dashboard documents."""
    placed = dashboards.where(S.present_id(F.col("id"))).select(
        F.col("id").alias("dashboard_id"), F.posexplode("widgets").alias("pos", "w"))
    place = F.col("w.options.position")
    return placed.select(
        "dashboard_id", F.col("pos").cast("long").alias("pos"), F.col("w.id").alias("widget_id"),
        F.col("w.visualization").isNotNull().alias("has_visualization"),
        F.col("w.visualization.type").alias("viz_type"),
        F.col("w.visualization.query.id").alias("query_id"),
        F.col("w.text").alias("text"),
        F.coalesce(place["row"], F.lit(0)).alias("row"),
        F.coalesce(place["col"], F.lit(0)).alias("col"))


def widget_kind(mode: str = "ranking") -> Column:
    """Widget type.  ``ranking`` keeps a missing type apart, ``counting`` calls it text."""
    if mode == "counting":
        return F.when(F.col("has_visualization"), F.coalesce("viz_type", F.lit("text"))
                      ).otherwise("text")
    return F.when(F.col("has_visualization"), F.coalesce("viz_type", F.lit("unknown_type"))
                  ).otherwise(NO_VISUALIZATION)


def _charts(widgets: DataFrame, mode: str) -> DataFrame:
    return widgets.where(~widget_kind(mode).isin("text", NO_VISUALIZATION))


def lineage_edges(widgets: DataFrame, mode: str = "ranking") -> DataFrame:
    """(dashboard, widget, query) of non-text widgets that name both a widget and a query."""
    known = S.present_id(F.col("query_id")) & S.present_id(F.col("widget_id"))
    return _charts(widgets, mode).where(known).select(
        "dashboard_id", "widget_id", "query_id", "pos")


def downstream_counts(edges: DataFrame) -> DataFrame:
    """Distinct dashboards and widgets per query."""
    return distinct_counts(edges, ["query_id"], {
        "downstream_dashboard_count": "dashboard_id", "downstream_chart_count": "widget_id"})


def queries_per_dashboard(edges: DataFrame) -> DataFrame:
    return distinct_counts(edges, ["dashboard_id"], {"query_count": "query_id"})


def widget_statistics(widgets: DataFrame) -> DataFrame:
    """Widgets, and charts without a query, per widget type, plus a ``total`` line."""
    no_query = ~widget_kind().isin("text", NO_VISUALIZATION) & ~S.present_id(F.col("query_id"))
    typed = widgets.select(widget_kind().alias("kind"), no_query.alias("no_query"))
    return typed.rollup("kind").agg(
        F.grouping("kind").alias("_total"), F.count(F.lit(1)).alias("widgets"),
        F.count_if("no_query").alias("without_query"),
    ).select(F.when(F.col("_total") == 1, "total").otherwise(F.col("kind")).alias("widget_type"),
             "widgets", "without_query")


def accessible_widgets(edges: DataFrame, fetched: DataFrame) -> DataFrame:
    """Widgets whose query was fetched.  One query per widget id: the last one listed wins."""
    last = edges.groupBy("widget_id").agg(
        F.max(F.struct("pos", "query_id"))["query_id"].alias("query_id"))
    return last.join(fetched.select(F.col("id").alias("query_id")), "query_id", "left_semi")


def orphan_queries(edges: DataFrame, fetched: DataFrame) -> DataFrame:
    """Distinct queries that widgets refer to but that were not fetched."""
    return edges.select("query_id").distinct().join(
        fetched.select(F.col("id").alias("query_id")), "query_id", "left_anti")


def lineage_summary(edges: DataFrame) -> DataFrame:
    """Counts of queries with dashboards, queries with charts, dashboards with queries."""
    return edges.agg(
        F.countDistinct("query_id").alias("queries_with_dashboards"),
        F.countDistinct("dashboard_id").alias("dashboards_with_queries"),
    ).select("queries_with_dashboards",
             F.col("queries_with_dashboards").alias("queries_with_charts"),
             "dashboards_with_queries")


def asset_counts(dashboards: DataFrame, accessible: DataFrame, saved_queries: DataFrame) -> DataFrame:
    """One row: dashboards, accessible widgets, saved queries."""
    def total(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = dashboards.agg(F.count(F.lit(1)).alias("dashboards"))
    return one.select("dashboards", total(accessible).alias("widgets"),
                      total(saved_queries).alias("saved_queries"))


# ---- saved queries ------------------------------------------------------------------


def query_features(saved: DataFrame, edges: DataFrame) -> DataFrame:
    """Saved-query fields with defaults, and their downstream counts (0 when unused)."""
    base = saved.where(S.present_id(F.col("id"))).select(
        "id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("query", F.lit("")).alias("query"), "created_at",
        person_name(F.col("user"), F.col("created_by")).alias("user_name"),
        "schedule", "updated_at")
    counts = downstream_counts(edges).withColumnRenamed("query_id", "id")
    return base.join(counts, "id", "left").fillna(
        0, ["downstream_dashboard_count", "downstream_chart_count"])


def score_queries(features: DataFrame, as_of) -> DataFrame:
    """Impact (6), recency (3) and curation (1) of saved queries, and their sum."""
    dash, chart = "downstream_dashboard_count", "downstream_chart_count"
    impact = 6 * (0.8 * S.log_share(F.col(dash), F.col(f"_top.{dash}"))
                  + 0.2 * S.log_share(F.col(chart), F.col(f"_top.{chart}")))
    age = S.elapsed_days(as_of, S.parse_iso(F.col("updated_at")))
    curation = (F.when(S.present(F.col("description")), 0.5).otherwise(0.0)
                + F.when(S.present_json(F.col("schedule")), 0.5).otherwise(0.0))
    return (S.with_maxima(features, dash, chart)
            .withColumn("impact_score", impact).drop("_top")
            .withColumn("recency_score", S.decay(age, 0.02, 3.0))
            .withColumn("curation_score", curation)
            .withColumn("golden_query_score",
                        F.col("impact_score") + F.col("recency_score") + F.col("curation_score")))


# ---- dashboards ---------------------------------------------------------------------


def dashboard_features(dashboards: DataFrame) -> DataFrame:
    return dashboards.where(S.present_id(F.col("id"))).select(
        "id", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("slug", F.lit("")).alias("slug"), "created_at", "updated_at",
        person_name(F.col("user"), F.col("created_by")).alias("user_name"),
        F.coalesce("is_draft", F.lit(False)).alias("is_draft"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def content_sums(edges: DataFrame, scored_queries: DataFrame) -> DataFrame:
    """Distinct queries of a dashboard, and the sum of their scores; unscored ones add nothing."""
    used = edges.select("dashboard_id", "query_id").distinct()
    scores = scored_queries.select(F.col("id").alias("query_id"), "golden_query_score")
    return used.join(scores, "query_id", "left").groupBy("dashboard_id").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum(F.coalesce("golden_query_score", F.lit(0.0))).alias("raw_content_score"))


def description_scores(widgets: DataFrame) -> DataFrame:
    """1.0 when the top-left text widget has content, 0.5 when it is blank."""
    texts = widgets.where(~F.col("has_visualization")
                          | (F.coalesce("viz_type", F.lit("")) == "text"))
    place = F.struct("row", "col", "pos", F.trim(F.coalesce("text", F.lit("")), F.lit(WHITESPACE)).alias("text"))
    first = texts.groupBy("dashboard_id").agg(F.min(place)["text"].alias("text"))
    return first.select("dashboard_id",
                        F.when(F.col("text") != "", 1.0).otherwise(0.5).alias("curation_score"))


def score_dashboards(features: DataFrame, widgets: DataFrame, edges: DataFrame,
                     scored_queries: DataFrame, as_of) -> DataFrame:
    """Content (7), recency (2) and curation (1) of dashboards, and their sum.

    ``scored_queries`` is read twice, for the sums and for their maximum: pass a staged table.
    """
    sums = content_sums(edges, scored_queries).withColumnRenamed("dashboard_id", "id")
    notes = description_scores(widgets).withColumnRenamed("dashboard_id", "id")
    raw = features.join(sums, "id", "left").fillna(0, ["query_count", "raw_content_score"])
    largest = F.nullif(F.col("_top.raw_content_score"), F.lit(0.0))
    content = 7 * F.coalesce(F.col("raw_content_score") / largest, F.lit(0.0))
    age = S.elapsed_days(as_of, S.parse_iso(F.col("updated_at")))
    return (S.with_maxima(raw, "raw_content_score")
            .join(notes, "id", "left").fillna(0.0, ["curation_score"])
            .withColumn("content_quality_score", content)
            .withColumn("recency_score", S.decay(age, 0.01, 2.0))
            .withColumn("golden_dashboard_score", F.col("content_quality_score")
                        + F.col("recency_score") + F.col("curation_score"))
            .drop("raw_content_score", "_top"))


# ---- rankings -----------------------------------------------------------------------


def ranked_queries(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("golden_query_score"), "id")


def ranked_dashboards(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("golden_dashboard_score"), "id")


def top_queries(scored: DataFrame, n: int = 5) -> DataFrame:
    return ranked_queries(scored).limit(n).withColumn("name", S.shorten(F.col("name"), 50))


def top_dashboards(scored: DataFrame, n: int = 5) -> DataFrame:
    """Best dashboards; ``query_count`` says how many queries each one uses."""
    return ranked_dashboards(scored).limit(n).withColumn("name", S.shorten(F.col("name"), 50))


def score_distribution(scored: DataFrame, *columns: str) -> DataFrame:
    """Lowest, highest and mean value per score column, one row per column."""
    stats = []
    for column in columns:
        stats.append(F.struct(F.lit(column).alias("score"), F.min(column).alias("lowest"),
                              F.max(column).alias("highest"), F.avg(column).alias("average")))
    return scored.agg(F.array(*stats).alias("s")).select(F.inline("s"))
