"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage


def _turned(links: DataFrame) -> DataFrame:
    """Each link as (hi, lo) with hi > lo, once."""
    return (links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
            .where("hi > lo").distinct())


def _centred(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct())


def _lowered(pairs: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = (pairs.join(least, "hi").where("lo > m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return least.select("hi", F.col("m").alias("lo")).unionAll(rest).distinct()


def _state(pairs: DataFrame) -> tuple:
    # Hashes are summed as decimals, which do not overflow.
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")))
                 .first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; longs), root = the smallest node
    that can be reached.

    Stars are joined alternately over larger and smaller neighbours until nothing changes, which
    takes a number of rounds logarithmic in practice.  Every round is written to the shared folder,
    so a lost executor costs one round.  Minima are combined before the shuffle; the joins put one
    row a node against its links, so adaptive skew splitting deals out a hub.  Rows with a null or
    with a = b say nothing and are left out; a node without links is not in the result.
    """
    pairs = stage(_turned(links), "links")
    before = _state(pairs)
    while True:
        pairs = stage(_lowered(_centred(pairs)), "links")
        now = _state(pairs)
        if now == before:
            break
        before = now
    return (pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionAll(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")))
            .distinct())
