"""Warehouse inventory: regions, logical tables, unique queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.predicates import logical_table_name

DEFAULT_REGION = "US"


def dataset_regions(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id", F.coalesce("location", F.lit(DEFAULT_REGION)).alias("region"))


def region_datasets(datasets: DataFrame) -> DataFrame:
    """Distinct dataset names of each region as one sorted list."""
    return dataset_regions(datasets).distinct().groupBy("region").agg(
        F.sort_array(F.collect_list("dataset_id")).alias("datasets"))


def tables_of_datasets(tables: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tables in the given datasets, matched on region and dataset."""
    wanted = dataset_regions(datasets).select("region", F.col("dataset_id").alias("table_schema"))
    return tables.join(wanted, ["region", "table_schema"], "left_semi")


def dataset_count(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id").distinct().agg(F.count(F.lit(1)).alias("datasets"))


def logical_tables(tables: DataFrame, by_dataset: bool = False) -> DataFrame:
    """Distinct table names without date-shard suffix, over all datasets or per dataset."""
    keys = ["table_schema"] if by_dataset else []
    return tables.select(*keys, logical_table_name(F.col("table_name")).alias("logical_name")).distinct()


def logical_table_count(tables: DataFrame, by_dataset: bool = False) -> DataFrame:
    return logical_tables(tables, by_dataset).agg(F.count(F.lit(1)).alias("logical_tables"))


def unique_queries_by_region(jobs: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct query texts per region.  The exact form compares digests of the texts, so
    the shuffle carries 32 bytes per distinct text and not the text itself."""
    digest = F.unhex(F.sha2(F.col("query"), 256))
    if approximate:
        return jobs.groupBy("region").agg(F.approx_count_distinct(digest).alias("unique_queries"))
    seen = jobs.where(F.col("query").isNotNull()).select("region", digest.alias("digest")).distinct()
    return seen.groupBy("region").agg(F.count(F.lit(1)).alias("unique_queries"))


def query_sketches(jobs: DataFrame, precision: int = 14) -> DataFrame:
    """A sketch of the distinct query texts of each region and day (a row each), to be stored.

    Sketches of later days are appended; the log itself is not read again.  ``precision`` is the
    logarithm of a sketch's buckets: at 14 a count is off by about 0.8 % (one standard deviation).
    """
    digest = F.unhex(F.sha2(F.col("query"), 256))
    return jobs.where(F.col("query").isNotNull()).groupBy(
        "region", F.to_date("creation_time").alias("day")).agg(
            F.hll_sketch_agg(digest, precision).alias("sketch"))


def unique_from_sketches(sketches: DataFrame, keys: Sequence[str] = ("region",),
                         since=None, until=None) -> DataFrame:
    """Distinct query texts by ``keys`` (region, day, or none) over the days from ``since`` to
    ``until``, both included, by merging stored sketches of one precision."""
    if since is not None:
        sketches = sketches.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.where(F.col("day") <= F.lit(until).cast("date"))
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_queries"))


def unique_query_count(jobs: DataFrame, global_distinct: bool = False) -> DataFrame:
    """Sum of the per-region counts, or with ``global_distinct`` one count over all regions."""
    source = jobs.withColumn("region", F.lit("all")) if global_distinct else jobs
    return unique_queries_by_region(source).agg(
        F.coalesce(F.sum("unique_queries"), F.lit(0)).alias("unique_queries"))


def _single(counted: DataFrame) -> Column:
    return counted.scalar()


def inventory_counts(datasets: DataFrame, tables: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: datasets, logical tables, unique queries."""
    return dataset_count(datasets).select(
        "datasets", _single(logical_table_count(tables)).alias("logical_tables"),
        _single(unique_query_count(jobs)).alias("unique_queries"))
