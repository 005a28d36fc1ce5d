"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column,
                    per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most ``per_class`` documents of each class that are not held
    out, first by a hash of doc_id, and the numbers of all such documents by class.

    Labels other than 0 and 1 and rows without doc_id are left out; of several labels of a document
    the largest holds, of several texts the smallest.
    """
    known = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = stage(known, "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = (known.where(F.col("label") == value)
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
        chosen = part if chosen is None else chosen.unionAll(part)
    # At most 2 * per_class rows of two numbers: small by construction.
    found = (docs.select(F.col("doc_id").cast("long"), "text")
             .join(F.broadcast(stage(chosen, "chosen")), "doc_id")
             .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    return stage(found, "sample"), counts
