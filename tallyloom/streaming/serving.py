"""Feature views that are refreshed from what has changed.

The serving table is a state table in entity buckets; a row has one struct for each feature group, its
latest source row.  A refresh folds the changed source rows to one row an entity, opens only the buckets
of those entities, and keeps of each group the later row, so rows may come in any order and twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.features import FeatureGroup, entity_key
from tallyloom.streaming.states import BUCKETS, StateTable, fold_into

ENTITY = "entity_id"


def group_states(group: FeatureGroup, features: list[str]) -> DataFrame:
    """One row an entity: its id and the group's latest row; rows without an id are left out.

    Of rows with equal times the one with the largest features counts.
    """
    if group.time_column is None:
        raise ValueError("a refreshed feature group needs a time column")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group.entity_id_columns])
    row = F.struct(F.col(group.time_column).alias("_at"), *features)
    return group.table.where(known).groupBy(entity_key(group.entity_id_columns).alias(ENTITY)).agg(
        F.max(row).alias(group.name))


class ServingTable:
    """A feature view below ``path``.  ``groups`` name the features and the schema of each source; the
    tables in them are only read for it."""

    def __init__(self, spark: SparkSession, path: str, groups: list[FeatureGroup],
                 features: list[list[str]], buckets: int = BUCKETS):
        if len(groups) != len(features):
            raise ValueError("one feature list per feature group is needed")
        self.groups = {g.name: (g, names) for g, names in zip(groups, features)}
        if len(self.groups) < len(groups):
            raise ValueError("feature groups need names of their own")
        self.path, self.buckets = path, buckets
        self.schema = self._union([group_states(g, names).limit(0) for g, names in self.groups.values()]).schema
        self.states = self._table(spark)

    def _table(self, spark: SparkSession) -> StateTable:
        return StateTable(spark, self.path, self.schema, [ENTITY], self.buckets)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _combined(self, changes: dict[str, DataFrame]) -> DataFrame:
        parts = []
        for name, rows in changes.items():
            group, names = self.groups[name]
            parts.append(group_states(FeatureGroup(name, rows, group.entity_id_columns, group.time_column), names))
        empty = parts[0].sparkSession.createDataFrame([], self.schema)
        return self._merged(self._union([empty, *parts]))

    def _merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(ENTITY).agg(*[F.max(name).alias(name) for name in self.groups])

    def refresh(self, changes: dict[str, DataFrame], batch: int | None = None) -> list[int]:
        """Fold changed source rows (by group name) in; returns the buckets that were rewritten.

        ``batch``: number of the refresh, by default the next; the last one may be repeated.
        """
        batch = self.states.version().batch + 1 if batch is None else batch
        fold_into(self._table, self._combined_of(changes), self._merged)(
            next(iter(changes.values())), batch)
        return sorted(k for k, b in self.states.version().files.items() if b == batch)

    def _combined_of(self, changes: dict[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda _: self._combined(changes)

    def follow(self, name: str, source: DataFrame, checkpoint: str):
        """Refresh from a stream of one group's source (new files only) until it is caught up.

        A table is followed by one stream at a time, whose batch numbers are the table's.
        """
        write = fold_into(self._table, lambda rows: self._combined({name: rows}), self._merged)
        query = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def view(self, entities: DataFrame | None = None) -> DataFrame:
        """The features of all entities, or with ``entities`` only of their buckets, named like
        those of ``features.feature_view``."""
        buckets = None if entities is None else self.states.touched(
            entities.select(F.col(ENTITY).cast("string").alias(ENTITY)))
        rows = self.states.rows(buckets=buckets)
        used = Counter(n for _, names in self.groups.values() for n in set(names))
        return rows.select(ENTITY, *[F.col(name)[n].alias(f"{name}_{n}" if used[n] > 1 else n)
                                     for name, (_, names) in self.groups.items() for n in names])
