"""Task hierarchy: all descendants of a task."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import present
from tallyloom.functions.staging import stage


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(present(F.col("parent_gid").cast("string"))
                       & present(F.col("child_gid").cast("string"))).select(
        "parent_gid", "child_gid").distinct()


def expanded_nodes(edges: DataFrame, roots: DataFrame | None = None,
                   max_depth: int | None = None) -> DataFrame:
    """(root_gid, node, depth) of every task whose subtasks are listed for a root.

    Breadth first, so ``depth`` is the least distance.  Each (root, node) appears once,
    which also ends cycles.  Only tasks that have subtasks matter here: leaves are left
    out, so a parent with very many plain children adds one row, not one per child.
    ``roots`` defaults to every task that has subtasks.  Each level is a written table, so
    the plan does not grow with the depth.  Levels follow until one is empty, or until
    ``max_depth`` when the caller sets one.
    """
    edges = _clean(edges)
    parents = edges.select(F.col("parent_gid").alias("node")).distinct()
    steps = stage(edges.join(parents.withColumnRenamed("node", "child_gid"), "child_gid",
                             "left_semi"), "hierarchy-steps")
    first = parents if roots is None else roots.select(
        F.col("root_gid").alias("node")).distinct().join(parents, "node", "left_semi")
    level = stage(first.select(F.col("node").alias("root_gid"), "node",
                               F.lit(0).alias("depth")), "hierarchy-level")
    levels = [level]
    for depth in (count(1) if max_depth is None else range(1, max_depth)):
        seen = reduce(DataFrame.unionByName, levels).select("root_gid", "node")
        reached = (level.join(steps, level["node"] == steps["parent_gid"])
                   .select("root_gid", F.col("child_gid").alias("node")).distinct())
        level = stage(reached.join(seen, ["root_gid", "node"], "left_anti")
                      .withColumn("depth", F.lit(depth)), "hierarchy-level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def subtask_closure(edges: DataFrame, roots: DataFrame | None = None,
                    max_depth: int | None = None) -> DataFrame:
    """Listed subtasks per root: every edge that leaves an expanded task.

    A task with two parents is listed once per parent, its own subtasks once; in a cycle
    the root is listed again.  With ``max_depth``, ``truncated`` tells the tasks whose own
    subtasks it leaves out.
    """
    nodes = expanded_nodes(edges, roots, max_depth)
    edges = _clean(edges)
    listed = nodes.join(edges, nodes["node"] == edges["parent_gid"]).select(
        "root_gid", "parent_gid", F.col("child_gid").alias("task_gid"),
        (F.col("depth") + 1).alias("depth"))
    if max_depth is None:
        return listed
    parents = edges.select(F.col("parent_gid").alias("task_gid"), F.lit(True).alias("_open")).distinct()
    known = nodes.select("root_gid", F.col("node").alias("task_gid"), F.lit(True).alias("_known"))
    return (listed.join(parents, "task_gid", "left").join(known, ["root_gid", "task_gid"], "left")
            .withColumn("truncated", F.col("_open").isNotNull() & F.col("_known").isNull())
            .drop("_open", "_known"))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Ancestor tables of ``nodes`` (node, up, own) by doubling.

    Table k has, for each node, the ancestor 2^k steps up (null: there is none), the sum of ``own`` over
    the node and its descendants less than 2^k steps down, the smallest node on the way up, and the
    furthest ancestor on it.  The last table has no ancestors left but those of rings.  So a chain of n
    takes log n tables of n rows.
    """
    tables = [stage(nodes.select("node", F.col("up").alias("ancestor"), F.col("own").alias("total"),
                                 F.col("node").alias("least"), F.coalesce("up", "node").alias("top")), "jumps")]
    before, steps = None, 1
    while True:
        last = tables[-1]
        going = last.where("ancestor IS NOT NULL").count()
        # Depths have no gaps: nobody arrived in this round, so those left go round in rings.
        if not going or (going == before and steps >= going):
            return tables
        received = last.where("ancestor IS NOT NULL").groupBy("ancestor").agg(F.sum("total").alias("more"))
        summed = last.join(received.withColumnRenamed("ancestor", "node"), "node", "left").withColumn(
            "total", F.col("total") + F.coalesce("more", F.lit(0))).drop("more")
        beyond = last.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"),
                             F.col("least").alias("smaller"), F.col("top").alias("further"))
        # Rows without an ancestor stay out of the join: all nulls would meet in one task.
        moved = summed.where("ancestor IS NOT NULL").join(beyond, "ancestor").select(
            "node", F.col("next").alias("ancestor"), "total",
            F.least("least", "smaller").alias("least"), F.col("further").alias("top"))
        tables.append(stage(moved.unionByName(summed.where("ancestor IS NULL")), "jumps"))
        before, steps = going, steps * 2


def _ancestors(of: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(node, ancestor) of the rows of ``of`` (node), themselves included: each distance is one sum of
    powers of two, so every pair comes out once."""
    found = of.select("node", F.col("node").alias("ancestor"))
    for table in tables:
        up = table.where("ancestor IS NOT NULL").select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        found = stage(found.unionByName(found.join(up, "ancestor").select(
            "node", F.col("next").alias("ancestor"))), "ancestors")
    return found


def _closed(steps: DataFrame) -> DataFrame:
    """Transitive closure of (a, b) by squaring."""
    steps = stage(steps.distinct(), "closure")
    size = steps.count()
    while True:
        twice = steps.join(steps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(
            "a", F.col("c").alias("b"))
        steps = stage(steps.unionByName(twice).distinct(), "closure")
        before, size = size, steps.count()
        if size == before:
            return steps


def subtask_counts(edges: DataFrame, roots: DataFrame | None = None,
                   max_depth: int | None = None) -> DataFrame:
    """Number of listed subtasks per root (gid, subtask_count), without listing them.

    Tasks with one parent form trees, whose sums are taken by doubling.  The trees are cut above tasks
    with several parents, and above one task of each ring; only for those is it listed who reaches
    them, since each counts once for a root, however often it is met.  With ``max_depth`` tasks are
    expanded level by level instead.
    """
    if max_depth is not None:
        nodes = expanded_nodes(edges, roots, max_depth)
        degrees = _clean(edges).groupBy(F.col("parent_gid").alias("node")).agg(
            F.count(F.lit(1)).alias("children"))
        return nodes.join(degrees, "node").groupBy(F.col("root_gid").alias("gid")).agg(
            F.sum("children").alias("subtask_count"))
    edges = stage(_clean(edges), "subtasks")
    degrees = stage(edges.groupBy(F.col("parent_gid").alias("node")).agg(
        F.count(F.lit(1)).alias("own")), "degrees")
    inner = stage(edges.join(degrees.select(F.col("node").alias("child_gid")), "child_gid", "left_semi"),
                  "inner-subtasks")
    parents = inner.groupBy(F.col("child_gid").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("parent_gid").alias("up"))
    cut = stage(parents.where("n > 1").select("node"), "cut-above")
    nodes = degrees.join(parents.where("n = 1").select("node", "up"), "node", "left")
    tables = _jumps(nodes)
    rings = tables[-1].where("ancestor IS NOT NULL")
    if not rings.isEmpty():
        # A jump of that many steps ends on a ring, where the way up is the ring itself.
        on_ring = rings.select(F.col("ancestor").alias("node")).distinct()
        least = rings.join(on_ring, "node", "left_semi").select(F.col("least").alias("node")).distinct()
        cut = stage(cut.unionByName(least), "cut-above")
        whole = nodes.join(least.withColumn("first", F.lit(True)), "node", "left")
        tables = _jumps(whole.select("node", F.when(F.col("first").isNull(), F.col("up")).alias("up"), "own"))
    trees = tables[-1].select("node", "total", "top")
    counts = trees.select(F.col("node").alias("gid"), F.col("total").alias("subtask_count"))
    if not cut.isEmpty():
        exits = inner.join(cut.select(F.col("node").alias("child_gid")), "child_gid", "left_semi")
        above = _ancestors(exits.select(F.col("parent_gid").alias("node")).distinct(), tables)
        direct = stage(exits.join(above, exits["parent_gid"] == above["node"]).select(
            F.col("ancestor").alias("a"), F.col("child_gid").alias("b")).distinct(), "reached")
        between = _closed(direct.join(cut.select(F.col("node").alias("a")), "a", "left_semi"))
        further = direct.join(between.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(
            "a", F.col("c").alias("b"))
        reached = direct.unionByName(further).distinct()
        sums = trees.select(F.col("node").alias("b"), F.col("total").alias("more"))
        tops = trees.select(F.col("node").alias("a"), "top")
        # Who comes back to the top of its own tree has that whole tree, itself in it.
        added = (reached.join(sums, "b").join(tops, "a").groupBy("a").agg(
            F.sum("more").alias("more"), F.bool_or(F.col("b") == F.col("top")).alias("back")))
        counts = trees.join(added.withColumnRenamed("a", "node"), "node", "left").select(
            F.col("node").alias("gid"),
            (F.when(F.coalesce("back", F.lit(False)), 0).otherwise(F.col("total"))
             + F.coalesce("more", F.lit(0))).alias("subtask_count"))
    return counts if roots is None else counts.join(
        roots.select(F.col("root_gid").alias("gid")).distinct(), "gid", "left_semi")
