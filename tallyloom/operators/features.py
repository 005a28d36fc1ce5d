"""Feature groups, views over several groups, and lookups by entity."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureGroup:
    """A table and the columns that identify its entities; ``time_column`` says which of
    several rows of an entity is the latest."""

    name: str
    table: DataFrame
    entity_id_columns: tuple[str, ...]
    time_column: str | None = None

    def __post_init__(self):
        if not self.entity_id_columns:
            raise ValueError("a feature group needs at least one entity id column")
        missing = set(self.entity_id_columns) - set(self.table.columns)
        if missing:
            raise ValueError(f"entity id columns not in the table: {sorted(missing)}")


def duplicate_entities(group: FeatureGroup) -> DataFrame:
    """Entities with more than one row: empty for a sound feature group."""
    return group.table.groupBy(*group.entity_id_columns).agg(
        F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def entity_key(columns: tuple[str, ...]) -> Column:
    """One text for the ids in ``columns``; that of a single column is its value as it is."""
    texts = [F.col(c).cast("string") for c in columns]
    if len(texts) == 1:
        return texts[0]
    return F.concat_ws("|", *[F.regexp_replace(t, r"([|\\])", r"\\$1") for t in texts])


def feature_view(groups: list[FeatureGroup], features: list[list[str]],
                 entity: str = "entity_id") -> DataFrame:
    """Full-outer join of the groups on their entity id, with the listed features.

    Group and feature lists must have equal length.  Several id columns are joined by ``|``; a ``|``
    or backslash inside one of them gets a backslash before it, so no two entities become one.
    Each entity has one row: of repeated ones the latest by the group's time column, without
    one that with the largest features.  A feature name that several groups have is written
    ``group_feature``.  Rows without an id are left out.
    """
    if len(groups) != len(features):
        raise ValueError("one feature list per feature group is needed")
    used = Counter(name for names in features for name in set(names))
    parts = []
    for group, names in zip(groups, features):
        key = entity_key(group.entity_id_columns)
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group.entity_id_columns])
        order = [F.col(group.time_column).alias("_at")] if group.time_column else []
        values = F.struct(*order, *[F.col(n) for n in names])
        latest = group.table.where(known).groupBy(key.alias(entity)).agg(F.max(values).alias("_row"))
        parts.append(latest.select(entity, *[
            F.col(f"_row.{n}").alias(f"{group.name}_{n}" if used[n] > 1 else n) for n in names]))
    return reduce(lambda a, b: a.join(b, entity, "full"), parts)


def view_from_request(request: DataFrame, groups: dict[str, FeatureGroup]) -> DataFrame:
    """Build a view from a one-row request document that names groups and features."""
    (row,) = request.select("feature_registry_source.feature_groups").limit(1).collect()
    listed = row["feature_groups"]
    return feature_view([groups[g["feature_group_id"]] for g in listed],
                        [list(g["feature_ids"]) for g in listed])


def materialise(view: DataFrame, path: str) -> None:
    """Compute a view and replace the serving table; run again to refresh."""
    view.write.mode("overwrite").parquet(path)


def lookup(view: DataFrame, wanted: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Features of the wanted entities, with ``found`` false for unknown ones."""
    marked = view.withColumn("found", F.lit(True))
    return (wanted.select(F.col(entity).cast("string").alias(entity)).distinct()
            .join(marked, entity, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def distinct_event_types(events: DataFrame) -> DataFrame:
    """Example feature: how many event types each user has produced."""
    pairs = events.select("user_id", "event_type").distinct()
    return pairs.groupBy("user_id").agg(F.count("event_type").alias("distinct_event_types"))
