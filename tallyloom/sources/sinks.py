"""Writers: quoted CSV, JSON records, per-artifact dumps, phase summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DUMP_PARTS = 64


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Columns of ``order`` that exist, all fields quoted, with a header.

    A sorted frame gives part files whose names follow the sort order.
    """
    chosen = df.select([F.col(f"`{c}`") for c in order if c in df.columns])
    (_flat(chosen).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def write_landed(df: DataFrame, path: str, time_column: str, sort_by: list[str],
                 looked_up: list[str] = (), day: str = "day", mode: str = "append",
                 row_group_bytes: int = 64 << 20) -> None:
    """A log laid out so that :func:`scans.read_landed` opens little of it: a folder per day (``day`` is
    added, null times in a folder of their own), rows sorted by ``sort_by`` then time, so the least and
    greatest values of a row group rule most of them out, and bloom filters on ``looked_up`` columns
    (and those of ``sort_by``), which rule out values that a row group does not hold.

    Tasks take ranges of day, sort columns and time together: a project with a third of all rows is
    dealt to several tasks, and a day to few files.
    """
    if day in df.columns:
        raise ValueError(f"the log has a column {day!r} of its own")
    keys = [day, *sort_by, time_column]
    writer = (df.withColumn(day, F.to_date(time_column)).repartitionByRange(*keys)
              .sortWithinPartitions(*keys).write.mode(mode).partitionBy(day)
              .option("parquet.block.size", row_group_bytes))
    for name in {*sort_by, *looked_up}:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", True)
    writer.parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per line, ISO times; an empty result still leaves its folder."""
    (df.write.mode("overwrite").option("ignoreNullFields", False)
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path))


def write_dump(lines: DataFrame, path: str) -> None:
    """Envelope lines (artifact, kind, id, data), a folder per artifact, replaced each run.  An
    artifact is written by up to ``DUMP_PARTS`` tasks, so a large one is no bottleneck."""
    part = F.pmod(F.xxhash64("kind", "id"), F.lit(DUMP_PARTS))
    (lines.repartition("artifact", part).write.mode("overwrite")
     .partitionBy("artifact").json(path))


def phase_summary(counted: dict[str, DataFrame], **details) -> DataFrame:
    """One row of named row counts, with literal details such as durations."""
    spark = next(iter(counted.values())).sparkSession
    counts = [df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name)
              for name, df in counted.items()]
    return spark.range(1).select(*counts, *[F.lit(v).alias(k) for k, v in details.items()])


def best_names(ranked: DataFrame, name: str, score: str, n: int = 5) -> DataFrame:
    """The first ``n`` (name, score) of an ordered frame as one list."""
    top = ranked.select(score, name).limit(n)
    return top.agg(F.reverse(F.sort_array(F.collect_list(F.struct(score, name)))).alias("best"))
