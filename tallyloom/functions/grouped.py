"""Grouping helpers that stay balanced when one key holds a large part of the rows.

A window or an array per key would send all rows of a hot key to one task.  The helpers
here cut a key's rows along an ordering value (time or a sequence number) into buckets,
work inside buckets, and stitch neighbouring buckets together from one summary row per
bucket.  Results are the same as those of the plain window; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.scalars import MICROS_PER_SECOND


def distinct_counts(df: DataFrame, keys: list[str], counted: dict[str, str]) -> DataFrame:
    """Exact distinct counts of several columns per key: ``{output name: column}``.

    Rows are fanned out to (key, which column, value) and deduplicated on that whole
    tuple before anything is gathered by key, so a hot key is spread over all tasks.
    Null values are not counted.
    """
    if len(counted) == 1:
        (name, column), = counted.items()
        return (df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
                  .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
    # Whole numbers stay numbers; columns of different kinds meet as text.
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in counted.values())
    kind = "long" if whole else "string"
    items = [F.struct(F.lit(i).alias("which"), F.col(c).cast(kind).alias("item"))
             for i, c in enumerate(counted.values())]
    marks = (df.select(*keys, F.inline(F.array(*items)))
               .where(F.col("item").isNotNull()).distinct())
    totals = [F.count_if(F.col("which") == i).alias(name) for i, name in enumerate(counted)]
    return marks.groupBy(*keys).agg(*totals)


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * MICROS_PER_SECOND))


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
                out: str = "position") -> DataFrame:
    """``row_number`` (from 1) per key in ``order``, computed bucket by bucket.

    ``bucket`` must not decrease along ``order``.
    """
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (Window.partitionBy(*keys).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (bucketed.withColumn("_rank", F.row_number().over(inside))
            .join(offsets, [*keys, "_bucket"])
            .withColumn(out, (F.col("_rank") + F.col("_offset")).cast("long"))
            .drop("_bucket", "_rank", "_offset"))


def list_segments(numbered: DataFrame, keys: list[str], value: str, size: int,
                  out: str, position: str = "position") -> DataFrame:
    """Ordered lists per key, in segments of at most ``size`` items.

    Segment 0 holds the whole list for every key with up to ``size`` items; longer lists
    continue in segments 1, 2, ... so that no row grows without bound and none is cut.
    """
    segment = F.floor((F.col(position) - 1) / F.lit(size)).cast("long")
    return (numbered.withColumn("segment", segment)
            .groupBy(*keys, "segment")
            .agg(F.sort_array(F.collect_list(F.struct(position, value))).alias("_pairs"))
            .select(*keys, "segment", F.col(f"_pairs.{value}").alias(out)))


def gap_statistics(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int = 900) -> DataFrame:
    """Count, mean and sample deviation (seconds) of the gaps between successive times per key.

    Equal times are first merged into one row with a multiplicity, so that neither a hot
    key nor a hot instant reaches one task.  Neighbours are then found inside short time
    buckets, and across buckets from each bucket's first and last time.  Merged times
    count as zero gaps.  All terms of the squared deviation are non-negative, so nearly
    constant gaps lose no precision.
    """
    moments = df.groupBy(*keys, F.unix_micros(ts).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    width = bucket_seconds * MICROS_PER_SECOND
    bucketed = moments.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at")
    gaps = bucketed.withColumn("_gap", F.col("_at") - F.lag("_at").over(inside))
    seconds = F.col("_gap") / F.lit(float(MICROS_PER_SECOND))
    summary = gaps.groupBy(*keys, "_bucket").agg(
        F.sum("_n").alias("n"),
        F.count("_gap").alias("m"),
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(seconds) * F.count("_gap"), F.lit(0.0)).alias("m2"),
        F.min("_at").alias("first"),
        F.max("_at").alias("last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    step = (F.col("first") - F.lag("last").over(across)) / F.lit(float(MICROS_PER_SECOND))
    runs = F.sum("n").over(whole)
    # Gaps add up to last - first, so their mean is known before any deviation is taken.
    span = (F.max("last").over(whole) - F.min("first").over(whole)) / F.lit(float(MICROS_PER_SECOND))
    centred = summary.select(
        *keys, "m", "mean", "m2", step.alias("step"), runs.alias("runs"),
        (span / F.nullif(runs - 1, F.lit(0))).alias("centre"))
    from_bucket = F.col("m2") + F.col("m") * F.pow(F.col("mean") - F.col("centre"), 2)
    from_step = F.coalesce(F.pow(F.col("step") - F.col("centre"), 2), F.lit(0.0))
    moves = F.sum("m") + F.count("step")
    gap_count = F.max("runs") - 1
    squares = (F.sum(from_bucket + from_step)
               + (gap_count - moves) * F.pow(F.max("centre"), 2))
    return centred.groupBy(*keys).agg(
        F.max("runs").alias("runs"),
        gap_count.alias("gap_count"),
        F.max("centre").alias("gap_mean"),
        F.when(gap_count == 1, F.lit(0.0))
         .when(gap_count > 1, F.sqrt(squares / (gap_count - 1))).alias("gap_stddev"))


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str,
                   out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, computed bucket by bucket.

    The first row of a bucket takes the last value of the key's bucket before it.
    ``bucket`` must not decrease along ``order``.
    """
    bucketed = df.withColumn("_bucket", bucket)
    last = bucketed.groupBy(*keys, "_bucket").agg(
        F.max(F.struct(*order, value))[value].alias("_last"))
    carried = last.select(*keys, "_bucket", F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = (bucketed.withColumn("_rank", F.row_number().over(inside))
              .withColumn("_before", F.lag(value).over(inside)))
    joined = ranked.join(carried, [*keys, "_bucket"])
    return (joined.withColumn(out, F.when(F.col("_rank") == 1, F.col("_carried"))
                              .otherwise(F.col("_before")))
            .drop("_bucket", "_rank", "_before", "_carried"))
