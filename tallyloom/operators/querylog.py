"""Query-log mining: from executed jobs to one feature row per query shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S
from tallyloom.functions import sqltext as Q
from tallyloom.functions.grouped import gap_statistics, list_segments, number_rows, time_bucket
from tallyloom.functions.staging import stage

# Column order of the feature export.
FEATURE_COLUMNS = [
    "query_shape_id", "statement_type", "total_execution_count", "distinct_user_count",
    "last_execution_timestamp", "creator_first_seen_user", "primary_user_most_frequent_executor",
    "join_count", "cte_count", "window_function_count", "aggregation_presence", "subquery_count",
    "destination_table", "is_temporary_write", "source_tables", "list_of_distinct_users",
    "full_execution_history", "execution_regularity_stdev", "normalized_sql",
    "hours_since_last_run", "regularity_hours", "complexity_score", "source_table_count",
    "is_service_account", "has_persistent_destination", "is_dml",
]
SINGLE_RUN = "SINGLE_EXECUTION"
#: First bits of a digest by which equally frequent texts are counted before some are chosen.
TIE_BITS = 12


def flatten_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with table references as dotted names."""
    return jobs.select(
        "user_email", "query", "creation_time", "start_time", "end_time", "statement_type",
        F.coalesce(F.transform("referenced_tables", P.qualified_name),
                   F.array().cast("array<string>")).alias("referenced_tables"),
        P.qualified_name(F.col("destination_table")).alias("destination_table"), "job_id", "region")


def with_shapes(jobs: DataFrame, mask_once: bool = False) -> DataFrame:
    """Jobs with ``query_shape_id`` and ``normalized_sql`` in place of the query text.

    By default every row is masked where it is read: a narrow step without a shuffle that
    no hot text can unbalance.  ``mask_once`` masks each distinct text once and joins the
    shape back on a digest of the text, which pays when long texts repeat many times; the
    join then relies on adaptive skew splitting for very frequent texts.
    """
    text = F.coalesce(F.col("query"), F.lit(""))
    if not mask_once:
        shaped = jobs.withColumn("normalized_sql", Q.shape_text(text))
        return shaped.withColumn(
            "query_shape_id", Q.shape_id(F.col("query"), F.col("normalized_sql"))).drop("query")
    keyed = jobs.withColumn("_text_id", F.sha2(text, 256))
    texts = (keyed.select("_text_id", text.alias("query")).distinct()
             .withColumn("normalized_sql", Q.shape_text(F.col("query")))
             .withColumn("query_shape_id", Q.shape_id(F.col("query"), F.col("normalized_sql")))
             .drop("query"))
    return keyed.drop("query").join(texts, "_text_id").drop("_text_id")


def text_digest(query):
    """Digest by which texts are grouped and joined, so that no text is a shuffle key; that of no
    text is empty."""
    return F.coalesce(F.unhex(F.sha2(query, 256)), F.unhex(F.lit("")))


def raw_query_counts(jobs: DataFrame, row: str = "job_id") -> DataFrame:
    """Digest and executions of each text, and the hash of ``row`` of one job that ran it.

    Digests, counts and hashes only, all of fixed width: hash aggregation on both sides of the shuffle.
    """
    return jobs.groupBy(text_digest(F.col("query")).alias("digest")).agg(
        F.count(F.lit(1)).alias("executions"), F.min(F.xxhash64(row)).alias("pick"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The rows of ``counts`` (digest, executions, ...) with the ``n`` highest counts; of equal ones
    those with the smallest digests.

    A histogram of the counts gives the lowest that gets in.  Among the digests that have it a
    histogram of their first bits gives the range in which the places end; only that range is sorted.
    """
    if n <= 0:
        return counts.limit(0)
    counts = stage(counts, "text-counts")
    above = F.coalesce(F.sum("texts").over(Window.orderBy(F.desc("executions")).rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    # One row a different count, in one task.
    last = (counts.groupBy("executions").agg(F.count(F.lit(1)).alias("texts"))
            .select("executions", "texts", above.alias("above"))
            .where(F.col("above") < n).orderBy("executions").first())
    if last is None or last["above"] + last["texts"] <= n:
        return counts if last is None else counts.where(F.col("executions") >= last["executions"])
    places = n - last["above"]
    head = F.coalesce(F.conv(F.substring(F.hex("digest"), 1, TIE_BITS // 4), 16, 10).cast("int"), F.lit(0))
    ties = counts.where(F.col("executions") == last["executions"]).withColumn("head", head)
    sizes = ties.groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()
    before = 0
    for range_ in sorted(sizes):
        if before + range_["n"] >= places:
            break
        before += range_["n"]
    edge = ties.where(F.col("head") == range_["head"]).orderBy("digest").limit(places - before)
    return (counts.where(F.col("executions") > last["executions"])
            .unionByName(ties.where(F.col("head") < range_["head"]).drop("head"))
            .unionByName(edge.drop("head")))


def top_raw_queries(jobs: DataFrame, n: int = 50_000, row: str = "job_id") -> DataFrame:
    """The ``n`` most frequent texts, most frequent first; equal counts in the order of their digests.

    Texts are chosen by digest; then one job of each is looked up for its text, so that no text is
    sorted, compared or sent before the choice.
    """
    chosen = most_frequent(raw_query_counts(jobs, row), n)
    texts = (jobs.select(text_digest(F.col("query")).alias("digest"), F.xxhash64(row).alias("pick"), "query")
             .join(chosen, ["digest", "pick"]).dropDuplicates(["digest"]))
    return texts.orderBy(F.desc("executions"), "digest").select("query", "executions")


def query_previews(jobs: DataFrame, n: int = 5, length: int = 100) -> DataFrame:
    return top_raw_queries(jobs, n).select(
        F.substring("query", 1, length).alias("preview"), "executions")


def candidate_jobs(jobs: DataFrame, n: int = 50_000) -> DataFrame:
    """Jobs whose text is among the ``n`` most frequent (:func:`most_frequent`).

    Texts are compared by digest; the planner chooses the join from the sizes it finds.
    """
    digest = text_digest(F.col("query"))
    counts = jobs.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("executions"))
    top = most_frequent(counts, n).select(F.col("digest").alias("_digest"))
    return jobs.withColumn("_digest", digest).join(top, "_digest", "left_semi").drop("_digest")


def usage_facts(shaped: DataFrame) -> DataFrame:
    """Runs, first and last time per (shape, user, statement type, destination, sources).

    One scan and one shuffle of map-side combined rows; usage, ownership and lineage
    columns are all taken from this small table.
    """
    return (shaped.groupBy("query_shape_id", "normalized_sql", "user_email", "statement_type",
                           "destination_table", "referenced_tables")
            .agg(F.count(F.lit(1)).alias("runs"),
                 F.min("creation_time").alias("first_run"),
                 F.max("creation_time").alias("last_run")))


def shape_users(facts: DataFrame) -> DataFrame:
    """Runs and first run per (shape, user): the distinct user list in long form."""
    return facts.groupBy("query_shape_id", "user_email").agg(
        F.sum("runs").alias("runs"), F.min("first_run").alias("first_run"))


def shape_sources(facts: DataFrame) -> DataFrame:
    """Distinct (shape, source table)."""
    return (facts.select("query_shape_id", "referenced_tables").distinct()
            .select("query_shape_id", F.explode("referenced_tables").alias("source_table"))
            .distinct())


def shape_profile(facts: DataFrame) -> DataFrame:
    """Usage, ownership, statement type and destination, one row per shape.

    Creator: user of the earliest run.  Primary user: most runs, then earliest.  Statement
    type: that of the first run.  Destination: the value when exactly one distinct non-null
    destination occurs, else null.  Remaining ties go to the lower name.  Facts are folded
    per user first, so a shape with very many users is combined on the map side.
    """
    opening = F.min(F.struct("first_run", "statement_type"))
    per_user = facts.groupBy("query_shape_id", "normalized_sql", "user_email").agg(
        F.sum("runs").alias("runs"), F.min("first_run").alias("first_run"),
        F.max("last_run").alias("last_run"), opening.alias("opening"),
        F.min("destination_table").alias("low"), F.max("destination_table").alias("high"))
    earliest = F.min(F.struct("first_run", "user_email"))
    # Least (-runs, first run, name) = most runs, earliest first.
    busiest = F.min(F.struct((-F.col("runs")).alias("rank"), "first_run", "user_email"))
    low, high = F.min("low"), F.max("high")
    temporary = P.is_temporary_write(F.col("destination_table"))
    return (per_user.groupBy("query_shape_id", "normalized_sql").agg(
                F.sum("runs").alias("total_execution_count"),
                F.count("user_email").alias("distinct_user_count"),
                F.max("last_run").alias("last_execution_timestamp"),
                earliest["user_email"].alias("creator_first_seen_user"),
                busiest["user_email"].alias("primary_user_most_frequent_executor"),
                F.min("opening")["statement_type"].alias("statement_type"),
                F.when(low == high, low).alias("destination_table"))
            .withColumn("is_temporary_write", temporary)
            .withColumn("has_persistent_destination", P.has_persistent_destination(
                F.col("destination_table"), F.col("is_temporary_write")))
            .withColumn("is_service_account",
                        P.is_service_account(F.col("primary_user_most_frequent_executor")))
            .withColumn("is_dml", P.is_dml(F.col("statement_type"))))


def shape_regularity(shaped: DataFrame, bucket_seconds: int = 900) -> DataFrame:
    """Sample deviation of gaps between runs: null and flagged for one run, 0 for two."""
    stats = gap_statistics(shaped, ["query_shape_id"], "creation_time", bucket_seconds)
    return stats.select(
        "query_shape_id", F.col("gap_stddev").alias("execution_regularity_stdev"),
        (F.col("runs") == 1).alias("is_single_execution"))


def regularity_hours():
    """Regularity in hours as two-decimal text, or the single-run marker."""
    hours = F.format_string("%.2f", F.col("execution_regularity_stdev") / 3600)
    return F.when(F.col("is_single_execution"), F.lit(SINGLE_RUN)).otherwise(hours)


def with_structure(shapes: DataFrame) -> DataFrame:
    """Structural counts and raw complexity of the shapes in ``normalized_sql``."""
    text = F.col("normalized_sql")
    counted = shapes.select(
        "*", Q.join_count(text).alias("join_count"), Q.cte_count(text).alias("cte_count"),
        Q.window_function_count(text).alias("window_function_count"),
        Q.has_group_by(text).alias("aggregation_presence"),
        Q.subquery_count(text).alias("subquery_count"))
    return counted.withColumn("raw_complexity_score", Q.raw_complexity(
        F.col("join_count"), F.col("cte_count"), F.col("window_function_count"),
        F.col("subquery_count"), F.col("aggregation_presence")))


def with_complexity(structured: DataFrame) -> DataFrame:
    """Raw score over the dataset's largest; all zero when the largest is zero."""
    largest = F.nullif(F.col("_top.raw_complexity_score"), F.lit(0))
    share = F.coalesce(F.col("raw_complexity_score") / largest, F.lit(0.0))
    return (S.with_maxima(structured, "raw_complexity_score")
            .withColumn("complexity_score", share).drop("_top"))


def query_features(shaped: DataFrame, as_of) -> DataFrame:
    """One feature row per shape: usage, ownership, lineage, structure, regularity.

    ``shaped`` is read once for the profile and once each for sources, gaps and the largest
    complexity, so pass a staged table when masking is costly.  Lists of users, sources and
    run times stay in their own tables (:func:`shape_users`, :func:`shape_sources`,
    :func:`execution_history`) and are attached for export by :func:`with_lists`.
    """
    facts = usage_facts(shaped)
    key = "query_shape_id"
    profile = with_complexity(with_structure(shape_profile(facts)))
    sources = shape_sources(facts).groupBy(key).agg(F.count(F.lit(1)).alias("source_table_count"))
    return (profile.join(shape_regularity(shaped), key)
            .join(sources, key, "left")
            .withColumn("source_table_count", F.coalesce("source_table_count", F.lit(0)))
            .withColumn("source_asset_golden_scores", F.lit(None).cast("array<double>"))
            .withColumn("destination_asset_golden_score", F.lit(None).cast("double"))
            .withColumn("hours_since_last_run",
                        S.elapsed_hours(as_of, F.col("last_execution_timestamp")))
            .withColumn("regularity_hours", regularity_hours()))


def execution_history(shaped: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """All run times per shape, numbered from 1 in time order."""
    return number_rows(
        shaped.select("query_shape_id", "creation_time", "job_id"), ["query_shape_id"],
        ["creation_time", "job_id"], time_bucket(F.col("creation_time"), bucket_seconds))


def history_segments(shaped: DataFrame, size: int = 10_000) -> DataFrame:
    """Run times as ascending ISO text lists, at most ``size`` per row, none left out."""
    numbered = execution_history(shaped).withColumn(
        "ran_at", F.date_format("creation_time", S.ISO_MICROS))
    return list_segments(numbered, ["query_shape_id"], "ran_at", size, "full_execution_history")


def _name_segments(names: DataFrame, column: str, size: int, out: str) -> DataFrame:
    # Names spread evenly over hash buckets; the list order is (bucket, name).
    bucket = F.pmod(F.xxhash64(column), F.lit(256))
    numbered = number_rows(names.withColumn("_hash", bucket), ["query_shape_id"],
                           ["_hash", column], F.col("_hash"))
    return list_segments(numbered, ["query_shape_id"], column, size, out)


def with_lists(features: DataFrame, shaped: DataFrame, size: int = 10_000) -> DataFrame:
    """Feature rows with the user, source and history lists of the export.

    A shape with longer lists gets further rows (``segment`` 1, 2, ...) that carry the
    continuation of each list.
    """
    facts = usage_facts(shaped)
    keys = ["query_shape_id", "segment"]
    users = _name_segments(shape_users(facts).select("query_shape_id", "user_email"),
                           "user_email", size, "list_of_distinct_users")
    sources = _name_segments(shape_sources(facts), "source_table", size, "source_tables")
    lists = (history_segments(shaped, size).join(users, keys, "full")
             .join(sources, keys, "full"))
    return features.join(lists, "query_shape_id")


def feature_export(with_list_columns: DataFrame) -> DataFrame:
    """Export columns in their fixed order, regularity as text."""
    text = F.when(F.col("is_single_execution"), F.lit(SINGLE_RUN)).otherwise(
        F.col("execution_regularity_stdev").cast("string"))
    ready = with_list_columns.withColumn("execution_regularity_stdev", text).withColumn(
        "last_execution_timestamp", F.date_format("last_execution_timestamp", S.ISO_MICROS))
    return ready.select([c for c in FEATURE_COLUMNS if c in ready.columns])


def coverage_reduction(shaped: DataFrame) -> DataFrame:
    """Jobs, shapes and the percentage by which shapes compress the log."""
    shapes = shaped.groupBy("query_shape_id").agg(F.count(F.lit(1)).alias("n"))
    totals = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"),
                        F.count(F.lit(1)).alias("shapes"))
    share = F.col("shapes") / F.nullif(F.col("jobs"), F.lit(0))
    return totals.withColumn("reduction_pct", (1 - share) * 100)
