"""Readers of landed metadata: explicit schemas, predicates that reach the files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions.scalars import present
from tallyloom.functions.staging import stage

LOOK_BACK_DAYS = 180


# The columns of a finished query job, and its region.
JOB_COLUMNS = ["user_email", "query", "creation_time", "start_time", "end_time", "statement_type",
               "referenced_tables", "destination_table", "job_id", "region"]


def read_jobs(spark: SparkSession, path: str, skip_damaged: bool = False) -> DataFrame:
    """Job history, laid out by region.  A missing or damaged file fails the read; with
    ``skip_damaged`` the other files are read, and :func:`unread_files` lists what was lost."""
    return (spark.read.schema(schemas.JOBS).option("ignoreMissingFiles", skip_damaged)
            .option("ignoreCorruptFiles", skip_damaged).parquet(path))


def read_landed(spark: SparkSession, path: str, schema: str, time_column: str, start=None, until=None,
                day: str = "day", **equal) -> DataFrame:
    """Rows of a log that :func:`sinks.write_landed` laid out, from ``start`` up to before ``until``,
    with the given values of columns.  Days are pruned by folder, row groups by sort order and bloom
    filter; rows without a time are found only if neither limit is given."""
    found = spark.read.schema(f"{schema}, `{day}` date").parquet(path)
    for limit, compare in ((start, F.col(day).__ge__), (until, F.col(day).__le__)):
        if limit is not None:
            found = found.where(compare(F.lit(limit).cast("timestamp").cast("date")))
    if start is not None:
        found = found.where(F.col(time_column) >= F.lit(start).cast("timestamp"))
    if until is not None:
        found = found.where(F.col(time_column) < F.lit(until).cast("timestamp"))
    for name, value in equal.items():
        found = found.where(F.col(name) == F.lit(value))
    return found.drop(day)


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, rows, read) of the job files below ``path`` that ``skip_damaged`` reads in part or
    not at all: rows as the file's footer has them (null: it has none to read), and rows read.

    A scan without columns takes its row counts from the footers, one with all columns decodes every
    page; where the second ends early the counts differ.  Only files of which neither gives a row are
    opened once more, to tell empty ones from damaged ones.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("file"), F.col("length").alias("size"))
    rows = read_jobs(spark, path, skip_damaged=True)
    jobs = rows.withColumn("file", F.col("_metadata.file_path"))
    stated = jobs.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    # The digest needs all columns of all rows, and is written so that it is not optimised away.
    decoded = jobs.groupBy("file").agg(F.count(F.lit(1)).alias("read"),
                                       F.bit_xor(F.xxhash64(*rows.columns)).alias("digest"))
    known = listed.join(stated, "file", "left").join(decoded, "file", "left").fillna(0, ["read"])
    known = stage(known, "read-files").drop("digest")
    silent = [r["file"] for r in known.where("rows IS NULL").select("file").collect()]
    lost = known.where("read < rows")
    if silent:
        # Footers of files without a row: few, and small unless damaged.
        opened = (spark.read.format("binaryFile").load(silent)
                  .mapInPandas(_footer_rows, "file string, rows long").where("rows IS NULL OR rows > 0"))
        lost = lost.unionByName(known.drop("rows").join(opened, "file").select("file", "size", "rows", "read"))
    return lost


def _footer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for content in batch["content"]:
            try:
                rows.append(parquet.ParquetFile(pa.BufferReader(content)).metadata.num_rows)
            except (pa.ArrowInvalid, OSError):
                rows.append(None)
        yield pd.DataFrame({"file": batch["path"], "rows": pd.array(rows, "Int64")})


def finished_queries(jobs: DataFrame, project: str | None, as_of: datetime,
                     days_back: int = LOOK_BACK_DAYS) -> DataFrame:
    """Nine columns (and region) of the finished query jobs of the last ``days_back`` days.

    Plain column-against-literal predicates, so that they are pushed into the files.
    """
    start = as_of - timedelta(days=days_back)
    kept = jobs.where((F.col("job_type") == "QUERY") & (F.col("state") == "DONE")
                      & (F.col("start_time") >= F.lit(start)))
    if project:
        kept = kept.where(F.col("project_id") == project)
    return kept.select(*JOB_COLUMNS)


def all_regions(*regions: DataFrame) -> DataFrame:
    """Bag union of per-region frames."""
    whole = regions[0]
    for region in regions[1:]:
        whole = whole.unionByName(region)
    return whole


def read_pages(spark: SparkSession, path: str, item: str,
               field: str = "results") -> DataFrame:
    """Items of landed listing pages (one JSON document per page); empty pages add nothing."""
    return (spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).json(path)
            .select(F.inline(field)))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines documents with their nested schema."""
    return spark.read.schema(schema).json(path)


def fetched(listed: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """Details of listed items; items without details are left out."""
    return details.join(listed.select(key).distinct(), key, "left_semi")


def not_fetched(listed: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    return listed.join(details.select(key), key, "left_anti")


def read_file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of the files below a folder, ``.git`` folders left out.

    For object stores.  Spark's file source skips empty files and names that begin with
    ``_`` or ``.``; use :func:`walk_files` where a checkout is mounted, or a file table.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    return files.where(~F.col("path").rlike(r"(^|/)\.git/") & present(F.col("path"))).select(
        "path", F.col("length").alias("size"), "content")


def walk_files(roots: DataFrame, head_bytes: int = -1) -> DataFrame:
    """(root, path, size, content) of every file below mounted folders, ``.git`` left out.

    ``roots`` has one folder per row in ``root``.  Folders are listed first and then spread
    over the tasks, so that one large checkout is read by many.  Files are read whole, or
    ``head_bytes`` of them; those that cannot be read have null content.
    """
    def folders(batches):
        for batch in batches:
            for root in batch["root"]:
                for folder, below, _ in os.walk(root):
                    below[:] = [d for d in below if d != ".git"]
                    yield pd.DataFrame({"root": [root], "folder": [folder]})

    def files(batches):
        for batch in batches:
            for root, folder in zip(batch["root"], batch["folder"]):
                for entry in os.scandir(folder):
                    if not entry.is_file(follow_symlinks=False):
                        continue
                    try:
                        with open(entry.path, "rb") as source:
                            head = source.read(head_bytes)
                    except OSError:
                        head = None
                    yield pd.DataFrame({"root": [root], "path": [entry.path],
                                        "size": [entry.stat().st_size], "content": [head]})

    listed = roots.select("root").distinct().mapInPandas(folders, "root string, folder string")
    return listed.repartition("folder").mapInPandas(
        files, "root string, path string, size long, content binary")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_LOG_ENTRIES).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)
