"""BI catalog: card kinds, item counts, samples and the dump envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.predicates import JSON_LIST, JSON_OBJECT, card_kind

ROW_SAMPLE = 10


def card_counts(cards: DataFrame) -> DataFrame:
    """One row: total, questions, models, metrics."""
    kind = card_kind(F.col("type"))
    return cards.agg(
        F.count(F.lit(1)).alias("total_cards"), F.count_if(kind == "cards").alias("questions"),
        F.count_if(kind == "models").alias("models"), F.count_if(kind == "metrics").alias("metrics"))


def artifact_counts(**listings: DataFrame) -> DataFrame:
    """Items per artifact (collections, dashboards, segments, snippets): all, not the samples."""
    parts = [df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("artifact"), "items")
             for name, df in listings.items()]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def first_per_artifact(items: DataFrame, artifact: Column, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` items of each artifact in listing order; callers that keep to a range
    use :func:`tallyloom.functions.scalars.clamp_sample_size` first.

    The row-number filter is pushed below the shuffle as a group limit, so each task sends
    at most ``n`` rows per artifact.
    """
    window = Window.partitionBy("artifact").orderBy(*order)
    return (items.withColumn("artifact", artifact)
            .withColumn("position", F.row_number().over(window)).where(F.col("position") <= n))


def sample_cards(cards: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return first_per_artifact(cards, card_kind(F.col("type")), order, n)


def dump_lines(sample: DataFrame, kind: str, data: Column) -> DataFrame:
    """Envelope rows (artifact, kind, id, data as JSON text)."""
    return sample.select("artifact", F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"),
                         F.to_json(data).alias("data"))


def row_as_map(names: Column, row: Column) -> Column:
    """A JSON result row as name -> value.

    A list is matched to the column names, short lists padded with null, of equal names the
    last kept; an object stays as it is; a bare value goes under ``_value``.
    """
    values = F.from_json(row, "array<string>")
    index = F.sequence(F.lit(1), F.size(names))
    # With no columns the sequence would count down from 1 to 0.
    index = F.when(F.size(names) > 0, index).otherwise(F.array().cast("array<int>"))
    last = F.filter(index, lambda i: ~F.array_contains(
        F.slice(names, i + 1, F.greatest(F.size(names) - i, F.lit(0))), F.element_at(names, i)))
    listed = F.map_from_arrays(F.transform(last, lambda i: F.element_at(names, i)),
                               F.transform(last, lambda i: F.try_element_at(values, i)))
    return (F.when(row.rlike(JSON_LIST), listed)
             .when(row.rlike(JSON_OBJECT), F.from_json(row, "map<string,string>"))
             .otherwise(F.create_map(F.lit("_value"), row)))


def sample_results(results: DataFrame, rows: int = ROW_SAMPLE) -> DataFrame:
    """First rows of each executed card as maps; ``cols`` names, ``rows`` JSON texts or lists.

    A card without rows has null rows, count 0 and a ``data_error``: the text in the column
    ``error`` where there is one.
    """
    nested = results.schema["rows"].dataType.elementType.typeName() == "array"
    kept = F.slice("rows", 1, rows)
    as_text = (lambda r: F.to_json(r)) if nested else (lambda r: r)
    told = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    return results.select(
        "card_id", F.col("cols").alias("columns"),
        F.transform(kept, lambda r: row_as_map(F.col("cols"), as_text(r))).alias("rows"),
        F.when(F.col("rows").isNotNull(), F.least(F.size("rows"), F.lit(rows))).otherwise(0)
         .alias("row_count_sampled"),
        F.when(F.col("rows").isNull(), F.coalesce(told, F.lit("no result"))).alias("data_error"))


def sample_result_rows(rows: DataFrame, order: list[str], n: int = ROW_SAMPLE) -> DataFrame:
    """First ``n`` rows per card of results landed one row per record."""
    window = Window.partitionBy("card_id").orderBy(*order)
    kept = rows.withColumn("row_number", F.row_number().over(window)).where(
        F.col("row_number") <= n)
    return kept.withColumn("row_count_sampled", F.count(F.lit(1)).over(
        Window.partitionBy("card_id")))
