"""Mixing sources to target weights: hash thresholds found from nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.batches import free_name

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a row's key, and bits that each histogram resolves.
KEY_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text: the order in which a source's documents are taken."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target words of each source.  ``sizes``: one row a source (source, source_size).

    Sources in code point order, null last, get the repeating weights; ``share`` of all words is
    dealt by weight, no source getting more than ``most`` times its size; what it leaves goes to
    the others by weight.  The level of that filling is found by going through the sources in the
    order in which they fill up.  This table has a row a source, so one task holds it.  A share above
    ``most`` cannot be dealt and is refused.
    """
    if share > most or min(weights) <= 0:
        raise ValueError(f"{share} of all words cannot be dealt at {most} times each source's, weights {weights}")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    named = sizes.select("source", "source_size", weight.alias("weight"),
                         (F.lit(most) * F.col("source_size")).alias("top"),
                         F.row_number().over(by_name).alias("place"))
    filling = Window.orderBy(F.col("top") / F.col("weight"), "place")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("top").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(earlier), F.lit(0))
    ranked = named.select("*", (left / open_weight).alias("level"),
                          F.row_number().over(filling).alias("rank"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("rank"))
    first = F.min(fits).over(everything)
    chosen = ranked.select("*", first.alias("first"))
    final = F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(everything)
    return chosen.select(
        "source", "source_size",
        F.when(F.col("rank") < F.col("first"), F.col("top"))
         .otherwise(final * F.col("weight")).alias("target"))


def _refined(sized: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """One histogram deeper: in each source's boundary bucket, the part in which the budget ends."""
    shift = KEY_BITS - LEVEL_BITS * (level + 1)
    rows = sized.select("source", "size", "key").alias("r").join(
        bounds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))
        & (F.shiftright("key", shift + LEVEL_BITS) == F.col("bucket")))
    counted = (rows.groupBy("b.source", "rest", "before",
                            F.shiftright("key", shift).alias("bucket"))
               .agg(F.sum("size").alias("words"), F.min("key").alias("low"),
                    F.max("key").alias("high")))
    along = Window.partitionBy("source").orderBy("bucket")
    reached = counted.withColumn("upto", F.col("before") + F.sum("words").over(along))
    return (reached.where(F.col("upto") >= F.col("rest"))
            .withColumn("nth", F.row_number().over(along)).where("nth = 1")
            .select("source", "rest", (F.col("upto") - F.col("words")).alias("before"), "bucket",
                    "words", "low", "high"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        word_count(F.col("text")).alias("size"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"))


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """A row a source: at (its name), source_size, target, whole (times that it is taken in full)
    and cut: rows with keys below it are taken once more.

    The cut is found from sums of words by source and key bits; each round looks only at the bucket
    in which the budget ends, until one key is left there.
    """
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                   weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                   ).otherwise(F.lit(0)).cast("long")
    plan = stage(aims.withColumn("whole", whole).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    zero = F.lit(0).cast("long")
    bounds = plan.where("rest > 0").select(
        "source", "rest", zero.alias("before"), zero.alias("bucket"))
    for level in range(KEY_BITS // LEVEL_BITS):
        bounds = stage(_refined(sized, bounds, level), "bounds")
        if bounds.where("low < high").isEmpty():
            break
    nearer = (F.col("rest") - F.col("before")) * 2 >= F.col("words")
    cuts = bounds.select(F.col("source").alias("at"),
                         (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("cut"))
    return stage(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("at")), "left")
        .select(F.col("source").alias("at"), "source_size", "target", "whole",
                F.coalesce("cut", zero).alias("cut")), "cuts")


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long) and taken (words) of every row of
    ``docs`` (doc_id, text, source).

    A source is taken whole as often as its target allows; the rest is the documents whose keys lie
    below a threshold.  The document at the threshold is taken if that comes nearer to the target,
    so the words of a source miss it by half a document at most.

    Null texts have size 0, null sources are a source of their own.  Rows that agree in id and text
    have one key: they are taken together or not at all.  A source without words has target 0, an
    empty table gives an empty result, other columns are not looked at.
    """
    sized = stage(_sized(docs), "sizes")
    cuts = thresholds(sized, weights, share, most)
    copies = F.col("whole") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
    return (sized.join(cuts, F.col("source").eqNullSafe(F.col("at")))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                    most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mixture`` takes them.  Texts are
    read a second time and meet the thresholds, a row a source, without being shuffled.  Rows are
    treated as :func:`mixture` says; other columns are carried along."""
    cut, copy = free_name(docs, "_cut"), free_name(docs, "_copy")
    cuts = thresholds(stage(_sized(docs), "sizes"), weights, share, most).select(
        F.struct("at", "whole", "cut").alias(cut))
    copies = F.col(cut)["whole"] + F.when(
        row_key(F.col("doc_id"), F.col("text")) < F.col(cut)["cut"], 1).otherwise(0)
    met = docs.join(cuts, F.col("source").cast("string").eqNullSafe(F.col(cut)["at"]))
    return (met.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
            .drop(cut, copy))


#: The mix in SQL: keys summed in order instead of by histogram.
MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, 2.0::DOUBLE * source_size AS top, [5, 2, 1][(place - 1) % 3 + 1] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY top / weight, place) AS rank,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(top) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / ((sum(weight) OVER ())
            - coalesce(sum(weight) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM named),
filled AS (
  SELECT (SELECT min(rank) FROM ranked WHERE level * weight <= top) AS first),
aims AS (
  SELECT source, source_size,
         CASE WHEN rank < first THEN top
              ELSE (SELECT level FROM ranked WHERE rank = first) * weight END AS target
  FROM ranked, filled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims),
summed AS (
  SELECT source, key, words, sum(words) OVER (PARTITION BY source ORDER BY key) - words AS before
  FROM (SELECT source, key, sum(size)::BIGINT AS words FROM sized GROUP BY source, key)),
cuts AS (
  SELECT s.source, min(CASE WHEN (target - whole * source_size - before) * 2 >= words THEN key + 1 ELSE key END) AS cut
  FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  WHERE target - whole * source_size > 0 AND before + words >= target - whole * source_size
  GROUP BY s.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * (whole + CASE WHEN d.key < coalesce(cut, 0) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""
