import math
import random
from collections import defaultdict

import pytest

from tallyloom.operators import hierarchy as H
from tallyloom.operators import tasks as T
from tallyloom.plans import ranking
from tallyloom.schemas import STORIES, SUBTASKS, TASKS

AS_OF = "2024-03-01 00:00:00"


def task(gid, done=False, due_on=None, due_at=None, modified=None, dependents=0, dependencies=0, followers=0):
    def some(n):
        return [{"gid": f"x{i}"} for i in range(n)] if n is not None else None
    return (gid, f"name {gid}", f"url {gid}", done, due_on, due_at, modified, ("ann",), None, "w",
            ("p", "proj"), some(dependencies), some(dependents), some(followers), None)


@pytest.fixture
def scored(spark):
    docs = spark.createDataFrame([
        task("a", due_on="2024-02-01", modified="2024-02-29T12:00:00Z", dependents=3, dependencies=1),
        task("b", done=True, due_on="", due_at="2024-03-05T00:00:00Z", modified="2024-02-20", followers=2),
        task("c", modified="junk", dependents=None, dependencies=None, followers=None)], TASKS)
    edges = spark.createDataFrame([("a", "s1"), ("s1", "s2"), ("b", None)], SUBTASKS)
    stories = spark.createDataFrame([("a", "1", "comment", "t", None), ("a", "2", "system", "t", None)], STORIES)
    return ranking.scored_task_documents(docs, edges, stories, AS_OF)


def test_scores(scored):
    got = {r.id: r for r in scored.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert [getattr(a, n) for n in T.COUNTS] == [3, 1, 2, 1, 0]
    assert [getattr(c, n) for n in T.COUNTS] == [0, 0, 0, 0, 0]
    assert a.impact_score == pytest.approx(5) and a.engagement_score == pytest.approx(3 * 0.8)
    assert a.timeliness_recency_score == pytest.approx(1 + 1)  # half a day counts as zero days
    assert b.due_date == "2024-03-05T00:00:00Z"
    assert b.timeliness_recency_score == pytest.approx(0.5 + math.exp(-0.2))
    assert b.golden_task_score == pytest.approx(0.2 * (0.6 + 0.5 + math.exp(-0.2)))
    assert c.golden_task_score == 0.0


def test_rank_output_and_summaries(scored):
    assert [(r["rank"], r.id) for r in T.top_tasks(scored, 2).collect()] == [(1, "a"), (2, "b")]
    out = T.task_output(scored)
    assert out.columns == T.TASK_COLUMNS
    row = out.where("id = 'a'").first()
    assert (row["project_data.name"], row.assignee, row.assignee_status, row.custom_fields) == ("proj", "ann", "", "")
    assert T.completion_counts(scored).first() == (1, 2, 33.3, 66.7)
    assert T.data_quality(scored).first() == (3, 33.3, 33.3, 33.3, 33.3)


def test_details_and_projects(spark):
    listed = spark.createDataFrame([("1", "old", "x"), ("2", "old", "y")], "gid string, name string, kept string")
    details = spark.createDataFrame([("1", "new", "more")], "gid string, name string, notes string")
    got = {r.gid: (r.name, r.kept, r.notes) for r in T.merge_details(listed, details).collect()}
    assert got == {"1": ("new", "x", "more"), "2": ("old", "y", None)}
    projects = spark.createDataFrame([("p", "P", "w")], "gid string, name string, workspace_id string")
    tasks = spark.createDataFrame([("1", "p"), ("2", "q")], "gid string, project_gid string")
    assert [(r.gid, r.workspace_id, r.project_data.name) for r in T.with_project(tasks, projects).collect()] == [
        ("1", "w", "P")]


def listed_subtasks(children, root, limit=1000):
    """Breadth-first listing: each task expanded once."""
    depth, queue, out = {root: 0}, [root], []
    for node in queue:
        if depth[node] >= limit:
            continue
        for child in sorted(children.get(node, ())):
            out.append((node, child))
            if child not in depth:
                depth[child] = depth[node] + 1
                queue.append(child)
    return out


def check_hierarchy(spark, pairs):
    children = {}
    for a, b in pairs:
        children.setdefault(a, set()).add(b)
    df = spark.createDataFrame(pairs, SUBTASKS)
    want = sorted((root, a, b) for root in children for a, b in listed_subtasks(children, root))
    got = sorted((r.root_gid, r.parent_gid, r.task_gid) for r in H.subtask_closure(df).collect())
    assert got == want
    counts = {r.gid: r.subtask_count for r in H.subtask_counts(df).collect()}
    assert counts == {root: len(listed_subtasks(children, root)) for root in children}
    return counts


def test_chain_is_followed_to_its_end(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(14)]
    counts = check_hierarchy(spark, chain)
    assert counts["n00"] == 14 and counts["n05"] == 9
    df = spark.createDataFrame(chain, "parent_gid string, child_gid string")
    cut = {r.task_gid: r.truncated for r in H.subtask_closure(df, max_depth=10).where("root_gid = 'n00'").collect()}
    assert cut == {f"n{i:02}": i == 10 for i in range(1, 11)}


def test_diamond_and_cycle(spark):
    counts = check_hierarchy(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"),
                                     ("x", "y"), ("y", "x")])
    assert counts["a"] == 5  # d is listed under both parents, e once
    assert counts["x"] == 2  # the root is listed again


def test_random_graph_with_a_hot_parent(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(40)}") for _ in range(60)}
    pairs |= {("n0", f"leaf{i}") for i in range(300)}
    check_hierarchy(spark, sorted(pairs))


def test_tree_counts_are_descendant_counts(spark):
    pairs = [(str(i // 3), str(i)) for i in range(1, 200)]
    counts = check_hierarchy(spark, pairs)
    assert counts["0"] == 199


def test_given_roots_only(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], SUBTASKS)
    roots = spark.createDataFrame([("b",), ("c",)], "root_gid string")
    assert [tuple(r) for r in H.subtask_counts(df, roots).collect()] == [("b", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_subtask_counts_without_pairs(spark, seed):
    draw = random.Random(seed)
    # Trees, tasks with several parents, rings with trees on them, loops of one task.
    edges = {(draw.randrange(k), k) for k in range(1, 40)}
    edges |= {(draw.randrange(40), draw.randrange(40)) for _ in range((0, 3, 8, 0)[seed])}
    edges |= {(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (200, 200), (200, 201), (201, 202)}
    if seed == 2:
        edges |= {(104, 101), (5, 100), (202, 201)}
    children = defaultdict(set)
    for a, b in edges:
        children[a].add(b)

    def reached(root):
        seen, todo = {root}, [root]
        while todo:
            for c in children.get(todo.pop(), ()):
                if c in children and c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen
    want = {root: sum(len(children[n]) for n in reached(root)) for root in list(children)}
    df = spark.createDataFrame(sorted(edges), "parent_gid long, child_gid long")
    assert {r.gid: r.subtask_count for r in H.subtask_counts(df).collect()} == want


def test_subtask_counts_of_a_long_chain(spark):
    df = spark.range(10_000).selectExpr("id AS parent_gid", "id + 1 AS child_gid")
    tables = H._jumps(df.selectExpr("parent_gid AS node", "nullif(parent_gid - 1, -1) AS up", "1L AS own"))
    assert len(tables) <= 16 and all(t.count() == 10_000 for t in tables)
    got = H.subtask_counts(df)
    assert got.where("subtask_count <> 10000 - gid").count() == 0 and got.count() == 10_000
