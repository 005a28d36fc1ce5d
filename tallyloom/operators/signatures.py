"""Query signatures over a table of logged queries, and pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import sqltext as Q

# The parts of a signature that are compared.
PARTS = ["leaf_tables", "join_edges", "agg_funcs", "set_ops", "has_limit", "has_order_by",
         "date_window"]


def with_date_window(queries: DataFrame, sql: str = "query") -> DataFrame:
    """Add ``date_window``: literal date bounds of the final result, intersected over UNION.
    Brackets that do not match leave it null."""
    marks = queries.withColumn("_marks", Q.marks(Q.dated(Q.canonical(F.col(sql)))))
    read = marks.withColumn("_fields", Q.fields(F.col("_marks"))).withColumn("_read", Q.scopes(F.col("_fields")))
    return read.select(*queries.columns, _decided(F.col("_read")).alias("date_window"))


def _decided(read: Column) -> Column:
    return F.when(read["whole"], Q.intersect_windows(read["windows"]))


def with_signature(queries: DataFrame, sql: str = "query", shape: str | None = None,
                   keep_catalog: bool = False, stripped: bool = False) -> DataFrame:
    """Add the seven signature parts, each text array sorted; with ``shape``, also the
    masked text under that name.  ``stripped``: the texts have no comments.

    Shared parts are columns of their own: Spark does not deduplicate expressions inside
    lambdas.
    """
    texts = queries.withColumn("_text", Q.dated(Q.canonical(F.col(sql), stripped)))
    parts = texts.withColumn("_marks", Q.marks(F.col("_text")))
    cut = parts.withColumn("_fields", Q.fields(F.col("_marks")))
    read = cut.withColumn("_read", Q.scopes(F.col("_fields"), keep_catalog))
    marks, found = F.col("_marks"), F.col("_read")
    return read.select(
        *queries.columns, *([Q.shape_of_dated(F.col("_text")).alias(shape)] if shape else []),
        found["tables"].alias("leaf_tables"), found["edges"].alias("join_edges"),
        Q.aggregate_functions(marks).alias("agg_funcs"),
        Q.set_operators(marks).alias("set_ops"),
        Q.has_limit(marks).alias("has_limit"),
        Q.has_order_by(marks).alias("has_order_by"),
        _decided(found).alias("date_window"))


def _shown(part: Column, is_array: bool) -> Column:
    return F.array_join(part, ",") if is_array else part.cast("string")


def compare_signatures(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full-outer comparison of two signature tables: equality, and a map of changed parts.

    A key present on one side only is unequal in every part that is set.
    """
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    kinds = {f.name: f.dataType.typeName() == "array" for f in left.schema.fields}
    changed = []
    for part in PARTS:
        x, y = F.col(f"a.{part}"), F.col(f"b.{part}")
        delta = F.struct(_shown(x, kinds[part]).alias("golden"), _shown(y, kinds[part]).alias("intern"))
        changed.append(F.struct(F.lit(part).alias("key"),
                                F.when(~x.eqNullSafe(y), delta).alias("value")))
    delta = F.map_filter(F.map_from_entries(F.array(*changed)), lambda _, v: v.isNotNull())
    return both.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), delta.alias("delta"),
    ).withColumn("signature_equal", F.size("delta") == 0)


def _numbered(tokens: Column) -> Column:
    """Tokens in order, repeats with the number of their equals before them: no item is repeated."""
    # The sorted array is bound once, since lambdas compute what they refer to again.
    return F.get(F.transform(F.array(F.sort_array(tokens)), lambda words: F.transform(
        words, lambda w, i: F.when((i > 0) & (w == F.get(words, i - 1)), F.concat_ws(
            " ", i - F.array_position(words, w), w)).otherwise(w))), F.lit(0))


def _alike(left: Column, right: Column) -> Column:
    """How many first items of two arrays are equal."""
    both = F.least(F.size(left), F.size(right))
    unlike = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(unlike > 0, unlike.cast("int") - 1).otherwise(both)


def token_changes(pairs: DataFrame, left: str, right: str, stripped: bool = False) -> DataFrame:
    """``pairs`` with the token comparison of two texts: same sequence, and removed and added
    counts of the multiset difference.  All of it is computed inside the row."""
    words = pairs.select("*", Q.tokens(F.col(left), stripped).alias("_old"),
                         Q.tokens(F.col(right), stripped).alias("_new"))
    # What both begin or end with is in both multisets: only the middles are counted.
    heads = words.withColumn("_head", _alike(F.col("_old"), F.col("_new")))
    rests = heads.select("*", *[F.slice(c, F.col("_head") + 1, F.size(c)).alias(f"{c}_rest") for c in ("_old", "_new")])
    tails = rests.withColumn("_tail", _alike(F.reverse("_old_rest"), F.reverse("_new_rest")))
    items = tails.select("*", *[_numbered(F.slice(f"{c}_rest", 1, F.size(f"{c}_rest") - F.col("_tail"))).alias(
        f"{c}_items") for c in ("_old", "_new")])
    shared = items.withColumn("_shared", F.size(F.array_intersect("_old_items", "_new_items")))
    return shared.select(
        *pairs.columns, (F.col("_old") == F.col("_new")).alias("text_equal"),
        (F.size("_old_items") - F.col("_shared")).cast("long").alias("tokens_removed"),
        (F.size("_new_items") - F.col("_shared")).cast("long").alias("tokens_added"))


def diff_pairs(pairs: DataFrame, key: str, left: str = "left_query",
               right: str = "right_query") -> DataFrame:
    """Compare two texts per row: same text once comments, spacing and case are evened out,
    same shape, same signature, changed signature parts, and token-level change counts."""
    # Both signatures are columns of the same row; no join is needed.
    plain = pairs.select(key, Q.strip_comments(F.col(left)).alias("_left"),
                         Q.strip_comments(F.col(right)).alias("_right"))
    pair = with_signature(token_changes(plain, "_left", "_right", True), "_left", "_left_shape", stripped=True)
    for part in PARTS:
        pair = pair.withColumnRenamed(part, f"golden_{part}")
    pair = with_signature(pair, "_right", "_right_shape", stripped=True)
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"golden_{part}").eqNullSafe(F.col(part)), F.lit(part)) for part in PARTS]))
    return (pair.select(
                key, (F.col("_left_shape") == F.col("_right_shape")).alias("shape_equal"),
                changed.alias("changed_parts"), "text_equal",
                F.coalesce("tokens_removed", F.lit(0)).alias("tokens_removed"),
                F.coalesce("tokens_added", F.lit(0)).alias("tokens_added"))
            .withColumn("signature_equal", F.size("changed_parts") == 0))
