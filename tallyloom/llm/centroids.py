"""Centroid clustering with an incremental distance matrix.

Every vector keeps its dot products with all centroids, in whole numbers.  When centroids move, only
the components that changed are multiplied and added to them; squared distances, and so the nearest
centroid, follow from the dot products and the lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage

SIZE = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Whole components up to this size: 64 squared differences of them fit a long.
LARGEST = 1 << 27

_STATE = "vec_id long, x array<long>, dots array<long>, cluster int, distance long"


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its numbers are, none of them infinite or not a number."""
    infinite = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite)),
                      F.lit(False))


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, x) of the rows with ``size`` finite numbers: x = floor(scale * number)."""
    def whole(v: Column) -> Column:
        number = F.floor(v.cast("double") * scale)
        return F.when(F.abs(number) <= LARGEST, number).otherwise(F.raise_error(F.lit(
            f"a number beyond {LARGEST // scale} gives distances that do not fit a long"))
            .cast("long"))

    fits = (F.size("embedding") == size) & is_finite(F.col("embedding"))
    return (vectors.where(fits).select(F.col("vec_id").cast("long").alias("vec_id"),
                                       F.transform("embedding", whole).alias("x")))


def first_centroids(whole: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest digests of their ids, one centroid a row."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = (whole.withColumn("digest", digest).orderBy(F.col("digest").asc_nulls_last(), "x")
            .limit(clusters).select("x").collect())
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def updated(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """``state`` with its dot products moved from the centroids ``before`` to those ``after``,
    and each vector's nearest centroid (of equally near ones the first)."""
    change = after - before
    moved = [(j, at) for j in range(len(change)) if len(at := np.flatnonzero(change[j]))]
    lengths = (after * after).sum(axis=1)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), batch.num_rows)
            dots = _matrix(batch.column("dots"), batch.num_rows).copy()
            for j, at in moved:
                dots[:, j] += x[:, at] @ change[j, at]
            squares = (x * x).sum(axis=1)[:, None] - 2 * dots + lengths
            nearest = squares.argmin(axis=1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dots.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"),
                 pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())),
                 pa.array(nearest.astype(np.int32)),
                 pa.array(squares[np.arange(len(nearest)), nearest])],
                names=["vec_id", "x", "dots", "cluster", "distance"])

    return state.select("vec_id", "x", "dots").mapInArrow(update, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a centroid without vectors stays.

    Sums are taken per task, then by cluster and component: a row a centroid and component comes
    to the driver.  They are added as decimals, which do not overflow.
    """
    clusters, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = np.asarray(batch.column("cluster"))
                x = _matrix(batch.column("x"), batch.num_rows)
                for j in np.unique(cluster):
                    sums[j] += x[cluster == j].sum(axis=0)
                counts += np.bincount(cluster, minlength=clusters)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, size)), pa.array(np.tile(np.arange(size), len(used))),
             pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], size))],
            names=["cluster", "component", "total", "n"])

    added = (state.select("x", "cluster")
             .mapInArrow(add, "cluster long, component long, total long, n long")
             .groupBy("cluster", "component")
             .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    out = centroids.copy()
    for row in added.collect():
        # Division of whole numbers rounds down, below zero as well.
        out[row["cluster"], row["component"]] = int(row["total"]) // row["n"]
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE,
              scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, distance) of every vector of ``size`` finite numbers in ``vectors``
    (vec_id, embedding), and the final centroids, one a row.

    Numbers are taken as floor(scale * number).  The dot products are written to the shared folder
    after every move of the centroids, so a lost executor costs part of one round.  Vectors that are
    null, of another length, or hold nulls or numbers that are not finite are left out; numbers
    whose distances may not fit a long end the job with an error.  Rows without vec_id take part, and start a
    centroid only if there are too few others; with fewer vectors than ``clusters`` each starts one.
    Repeated rows count as often as they come (each may start a centroid); an empty table gives an
    empty result; other columns are not looked at.
    """
    whole = stage(whole_vectors(vectors, size, scale), "whole-vectors")
    centroids = first_centroids(whole, clusters)
    none = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    if not len(centroids):
        return whole.select("vec_id", "x", none.alias("dots"), F.lit(0).alias("cluster"),
                            F.lit(0).cast("long").alias("distance")), centroids
    before = np.zeros_like(centroids)
    state = stage(updated(whole.select("vec_id", "x", none.alias("dots")), before, centroids), "dots")
    for _ in range(rounds):
        before, centroids = centroids, means(state, centroids)
        state = stage(updated(state, before, centroids), "dots")
    return state, centroids


def cluster_report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every clustered
    vector; rows as :func:`clustered` has them."""
    state, centroids = clustered(vectors, clusters, rounds)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    told = [(j, sums.get(j, 0), sum(sums.values()),
             hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
            for j, c in enumerate(centroids)]
    # A row a centroid.
    table = F.broadcast(spark.createDataFrame(
        told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.select("vec_id", "cluster", "distance").join(table, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
near{r} AS (
  SELECT rid, vec_id, x, cluster, distance FROM (
    SELECT rid, vec_id, x, cluster,
           list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, {SIZE + 1})])::BIGINT AS distance
    FROM kept, centroid{r})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""
mean{r} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM near{r}, range(1, {SIZE + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster),
centroid{r + 1} AS (
  SELECT cluster, coalesce(m.c, old.c)::BIGINT[] AS c
  FROM centroid{r} old LEFT JOIN mean{r} m USING (cluster))""")
    return ",".join(parts)


#: The same clustering over all distances of every round.
CLUSTERS_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id,
         [floor({SCALE} * v::DOUBLE)::BIGINT FOR v IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {SIZE}
    AND len([v FOR v IN embedding IF v IS NULL OR isnan(v) OR isinf(v)]) = 0),
centroid0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster, x AS c
  FROM kept QUALIFY cluster < {CLUSTERS}),{_rounds_sql(ROUNDS)},
summed AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia,
       (SELECT sum(cluster_inertia)::BIGINT FROM summed) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN summed USING (cluster) JOIN centroid{ROUNDS} USING (cluster)
"""
