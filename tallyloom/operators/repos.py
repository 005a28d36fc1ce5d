"""Repositories: files, pull requests and commits per repository, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S

KEY = ["org", "repo"]
COUNTS = ["files", "prs", "commits"]


def repositories(repos: DataFrame) -> DataFrame:
    """Named repositories with defaults for size, flags and branch; nameless rows are skipped."""
    named = repos.withColumn("repo", P.repository_key(F.col("slug"), F.col("name"),
                                                      F.col("full_name")))
    return named.where(S.present(F.col("repo"))).select(
        "org", "repo", "full_name", "html_url",
        F.coalesce("size", F.lit(0)).alias("size"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("fork", "private", "archived")],
        F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main")).alias("default_branch"))


def valid_repositories(repos: DataFrame) -> DataFrame:
    return repos.where(P.is_valid_repository(F.col("name"), F.col("full_name"), F.col("html_url")))


def countable_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return files.where(P.is_countable_file(F.col("type"), F.col("path"), F.col("size"), max_bytes))


def file_counts(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return countable_files(files, max_bytes).groupBy(*KEY).agg(F.count(F.lit(1)).alias("files"))


def oversized_files(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files per repository that ``max_bytes`` leaves out of :func:`file_counts`."""
    return countable_files(files).where(F.col("size") > max_bytes).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("skipped_files"))


def text_files(contents: DataFrame) -> DataFrame:
    """Rows of (path, content) whose name or content says text."""
    return contents.where(P.is_probably_text(F.col("path"), F.col("content")))


def valid_pull_requests(prs: DataFrame) -> DataFrame:
    return prs.where(P.is_valid_pull_request(
        *[F.col(c) for c in ("id", "title", "html_url", "author", "head", "base")]))


def pull_request_counts(prs: DataFrame) -> DataFrame:
    """Valid pull requests per repository, all states, without a page limit."""
    return valid_pull_requests(prs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("prs"))


def commit_counts(commits: DataFrame) -> DataFrame:
    """Distinct commits per repository; deduplicated on the whole key before gathering."""
    return (commits.where(F.col("sha").isNotNull()).select(*KEY, "sha").distinct()
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("commits")))


def repo_metrics(repos: DataFrame, files: DataFrame, prs: DataFrame, commits: DataFrame,
                 failures: DataFrame | None = None) -> DataFrame:
    """One record per repository; a missing or failed count is 0.

    ``failures`` (org, repo, message) keeps the error text of counts that could not be taken.
    """
    record = repos.select(*KEY)
    for counts in (file_counts(files), pull_request_counts(prs), commit_counts(commits)):
        record = record.join(counts, KEY, "left")
    record = record.fillna(0, COUNTS)
    if failures is None:
        return record.withColumn("error", F.lit(None).cast("string"))
    first = failures.groupBy(*KEY).agg(F.min("message").alias("error"))
    return record.join(first, KEY, "left")


def repo_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("repos"),
                       *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def organisation_summary(metrics: DataFrame) -> DataFrame:
    """Totals, repositories with each kind of activity, averages to two places."""
    repos = F.count(F.lit(1))
    return metrics.agg(
        repos.alias("repos"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
        *[F.count_if(F.col(c) > 0).alias(f"repos_with_{c}") for c in COUNTS],
        *[S.per_item(F.coalesce(F.sum(c), F.lit(0)), repos, 2).alias(f"avg_{c}_per_repo")
          for c in COUNTS])


def active_share(metrics: DataFrame) -> DataFrame:
    """Repositories with any activity, their share in percent, averages to one place."""
    repos = F.count(F.lit(1))
    active = F.count_if((F.col("files") > 0) | (F.col("prs") > 0) | (F.col("commits") > 0))
    return metrics.agg(
        active.alias("active_repos"), repos.alias("repos"),
        S.percentage(active, repos).alias("active_pct"),
        *[S.per_item(F.coalesce(F.sum(c), F.lit(0)), repos, 1).alias(f"avg_{c}") for c in COUNTS])


def by_activity(metrics: DataFrame) -> DataFrame:
    total = F.col("files") + F.col("prs") + F.col("commits")
    return metrics.withColumn("activity", total).orderBy(F.desc("activity"), *KEY)
