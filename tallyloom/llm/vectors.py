"""Embedding near-duplicates: tiles of vectors, compared in the order of principal axes.

Vectors of one label are cut into tiles along their first principal coordinate.  Tiles that lie too
far apart there are never brought together; inside a pair of tiles, products are summed over the
leading axes first, and a pair of vectors is dropped as soon as the lengths of what is left of both
cannot lift its cosine to the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.components import connected

COSINE = 0.98
#: Most vectors of a tile, apart from chance, and coordinates summed before each test.
TILE = 512
STEP = 16
#: What rounding may take from a bound.
SLACK = 1e-9
_PAIRS = 1 << 15


def _unit(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and the same at length 1; scaled first, so nothing overflows."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def can_link() -> Column:
    """Whether a row can link: a label, and a vector of finite numbers that are not all zero."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)
                      & (F.abs(v) < F.lit(math.inf)))
    some = F.exists("embedding", lambda v: v != 0)
    return F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and the hashes node and check, by which equal vectors are known."""
    return vectors.select(F.col("vec_id").cast("long"), "label", "embedding",
                          F.xxhash64("label", "embedding").alias("node"),
                          F.hash("embedding", "label").alias("check"))


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the axes, as columns, by falling variance over all vectors.

    Second moments are added up in each partition and then by entry; only they, the square of a
    vector's length in numbers, come to the driver.
    """
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in batch.groupby("size"):
                _, unit = _unit(list(part["embedding"]))
                sums[size] = sums.get(size, 0.0) + unit.T @ unit
        for size, total in sums.items():
            yield pd.DataFrame({"size": size, "entry": np.arange(size * size),
                                "value": total.ravel()})

    entries = (distinct.select("size", "embedding")
               .mapInPandas(moments, "size int, entry long, value double")
               .groupBy("size", "entry").agg(F.sum("value").alias("value")).toPandas())
    axes = {}
    for size, part in entries.groupby("size"):
        square = part.sort_values("entry")["value"].to_numpy().reshape(size, size)
        axes[int(size)] = np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]
    return axes


def linked_pairs(left: np.ndarray, right: np.ndarray, turned_left: np.ndarray,
                 turned_right: np.ndarray, same: bool, cosine: float) -> np.ndarray:
    """Row pairs (i, j) with at least that cosine; i < j if both sides are the ``same``.

    ``left``, ``right``: vectors; ``turned_*``: the same at length 1 in principal coordinates.
    """
    size = turned_left.shape[1]
    marks = list(range(STEP, size, STEP)) or [size]
    tails = [[np.sqrt((t[:, m:] ** 2).sum(axis=1)) for m in marks]
             for t in (turned_left, turned_right)]
    first = marks[0]
    sums = turned_left[:, :first] @ turned_right[:, :first].T
    possible = sums + np.outer(tails[0][0], tails[1][0]) >= cosine - SLACK
    if same:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    found = []
    for k in range(0, len(i), _PAIRS):
        a, b = i[k:k + _PAIRS], j[k:k + _PAIRS]
        partial = sums[a, b]
        for n, (start, stop) in enumerate(zip(marks, marks[1:]), 1):
            partial = partial + (turned_left[a, start:stop] * turned_right[b, start:stop]).sum(axis=1)
            able = partial + tails[0][n][a] * tails[1][n][b] >= cosine - SLACK
            a, b, partial = a[able], b[able], partial[able]
        x, y = left[a], right[b]
        exact = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        found.append(np.column_stack([a, b])[exact >= cosine])
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _groups(count: int, pairs: np.ndarray) -> list[np.ndarray]:
    """Members of each connected group of two rows or more."""
    touching = np.zeros((count, count), bool)
    touching[pairs[:, 0], pairs[:, 1]] = touching[pairs[:, 1], pairs[:, 0]] = True
    left, out = touching.any(axis=1), []
    while left.any():
        reached = np.zeros(count, bool)
        frontier = np.flatnonzero(left)[:1]
        while len(frontier):
            reached[frontier] = True
            frontier = np.flatnonzero(touching[frontier].any(axis=0) & ~reached)
        out.append(np.flatnonzero(reached))
        left &= ~reached
    return out


def _compared(distinct: DataFrame, cosine: float, tile: int) -> DataFrame:
    """From all pairs of tiles: rows (node, check, links) with links of a vector, counting copies,
    and rows (node, other) that join what is linked."""
    axes = principal_axes(distinct)
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    width = max(reach / 2, SLACK)

    @F.pandas_udf("long")
    def band(embedding: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        for s in size.unique():
            at = np.flatnonzero(size == s)
            _, unit = _unit(list(embedding.iloc[at]))
            out[at] = np.floor(unit @ axes[s][:, 0] / width)
        return pd.Series(out)

    placed = stage(distinct.withColumn("band", band("embedding", "size")), "placed")
    key = ["label", "size"]
    bands = stage(placed.groupBy(*key, "band").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles")), "bands")
    # The reach is two bands wide, so vectors three bands apart never link.
    shifts = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)]))
    near = (bands.withColumn("shift", shifts)
            .withColumn("other", F.col("band") + F.col("shift"))
            .join(bands.select(*key, F.col("band").alias("other"), F.col("tiles").alias("others")),
                  [*key, "other"]).drop("shift"))
    rows = (placed.join(near, [*key, "band"])
            .withColumn("own", F.pmod(F.col("node"), F.col("tiles")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1))))
    mine, theirs = F.struct("band", "own"), F.struct(F.col("other").alias("band"),
                                                     F.col("with").alias("own"))
    dealt = rows.select(*key, "node", "check", "copies", "embedding",
                        (mine > theirs).alias("second"), F.least(mine, theirs).alias("low"),
                        F.greatest(mine, theirs).alias("high"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        x, unit = _unit(list(part["embedding"]))
        turned = unit @ axes[x.shape[1]]
        second = part["second"].to_numpy()
        copies, node = part["copies"].to_numpy(), part["node"].to_numpy()
        a = np.flatnonzero(~second)
        b = np.flatnonzero(second)
        same = part["low"].iloc[0] == part["high"].iloc[0]
        other = a if same else b
        pairs = linked_pairs(x[a], x[other], turned[a], turned[other], same, cosine)
        pairs = np.column_stack([a[pairs[:, 0]], other[pairs[:, 1]]])
        links = (np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(part))
                 + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(part))).astype(np.int64)
        linked = np.flatnonzero(links)
        joins = [(node[g[0]], node[m]) for g in _groups(len(part), pairs) for m in g[1:]]
        heads, members = zip(*joins) if joins else ((), ())
        return pd.DataFrame({
            "node": np.concatenate([node[linked], np.array(heads, np.int64)]),
            "check": np.concatenate([part["check"].to_numpy()[linked],
                                     np.zeros(len(joins), np.int32)]),
            "links": np.concatenate([links[linked], np.zeros(len(joins), np.int64)]),
            "other": pd.array([None] * len(linked) + list(members), dtype="Int64")})

    return (dealt.groupBy(*key, "low", "high")
            .applyInPandas(compare, "node long, check int, links long, other long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if labels and lengths are equal and their cosine in double precision is at least
    ``cosine``.  n_links counts other rows, copies one by one; component_id is the smallest vec_id
    reachable; kept: that is the row's own.  Equal vectors are compared once.  Rows that cannot link
    (no label; a null, empty or zero vector, or one with null or non-finite numbers) and rows
    without links are their own component.  Rows without vec_id take part; a component of only such
    rows is null and kept.  Repeated rows link with each other; an empty table gives an empty
    result; other columns are not looked at.  Equal vectors and nodes are told by 64-bit hashes.
    """
    rows = _keyed(vectors)
    distinct = stage(rows.where(can_link()).groupBy("label", "node", "check").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"),
        F.any_value("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding")), "vectors")
    seen = stage(_compared(distinct, cosine, tile), "tiles")
    links = seen.where("other IS NULL").groupBy("node", "check").agg(F.sum("links").alias("links"))
    roots = connected(seen.where("other IS NOT NULL").select(
        F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = stage(distinct.select("node", "check", "first", "copies")
                   .join(links, ["node", "check"], "left").join(roots, "node", "left")
                   .select("node", "check", "first", F.coalesce("root", "node").alias("root"),
                           (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
                   "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(smallest, "root").select("node", "check", "n_links", "component_id")
    able = rows.where(can_link()).select("vec_id", "node", "check").join(known, ["node", "check"]).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where(~can_link()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionAll(alone).select(
        "*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Links and components in SQL, over all pairs of a label.
DUPLICATES_SQL = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
able AS (
  SELECT * FROM rows
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND list_sum([abs(x) FOR x IN v]) > 0
    AND len([x FOR x IN v IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
links AS (
  SELECT a.rid AS rid, b.rid AS other FROM able a JOIN able b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (
  SELECT rid, vec_id AS root FROM rows
  UNION SELECT l.other, r.root FROM reached r JOIN links l ON l.rid = r.rid),
found AS (SELECT rid, min(root) AS component_id FROM reached GROUP BY rid),
counted AS (SELECT rid, count(*) AS n FROM links GROUP BY rid)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id,
       vec_id IS NOT DISTINCT FROM component_id AS kept
FROM rows JOIN found USING (rid) LEFT JOIN counted USING (rid)
"""
