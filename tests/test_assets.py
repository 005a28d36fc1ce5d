import math

import pytest

from tallyloom.operators import assets as A
from tallyloom.schemas import DASHBOARDS, SAVED_QUERIES

AS_OF = "2024-03-01 00:00:00"


def widget(wid, query=None, kind="chart", viz=True, text="", row=None, col=None):
    place = None if row is None and col is None else {"position": {"row": row, "col": col}}
    return {"id": wid, "text": text, "options": place,
            "visualization": {"type": kind, "query": {"id": query}} if viz else None}


def board(bid, widgets, updated="2024-03-01T00:00:00Z", user=("ann",), creator=("bob",), draft=None):
    return (bid, f"board {bid}", None, None, updated, user, creator, draft, None, widgets)


def saved(qid, description=None, schedule=None, updated="2024-03-01T00:00:00Z", user=("ann",), creator=None):
    return (qid, f"query {qid}", description, None, None, updated, schedule, user, creator)


@pytest.fixture
def boards(spark):
    return spark.createDataFrame([
        board(1, [widget(1, 10), widget(2, 10), widget(3, 11), widget(4, 0), widget(5, None),
                  widget(6, 12, "text", text=" x ", row=2, col=0), widget(7, viz=False, text=" \n\t", row=1, col=5),
                  widget(8, 13, None)]),
        board(2, [widget(9, 10), widget(10, viz=False, text="hello")], draft=True),
        board(3, [], user=None), board(4, None, user=None, creator=None), board(0, [widget(11, 10)]),
        board(None, [widget(12, 10)])], DASHBOARDS)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([
        saved(10, "d", '{"interval": 5}'), saved(11, "", '{"interval": 5}'), saved(13, "d", None, "2024-02-20T00:00:00Z"),
        saved(14, None, "{}", "2024-03-11T00:00:00Z"), saved(15, updated="junk", user=None, creator=("c",)),
        saved(None), saved(0)], SAVED_QUERIES)


def test_edges_in_both_modes(boards):
    widgets = A.flatten_widgets(boards)
    ranking = {(r.dashboard_id, r.widget_id, r.query_id) for r in A.lineage_edges(widgets).collect()}
    assert ranking == {(1, 1, 10), (1, 2, 10), (1, 3, 11), (1, 8, 13), (2, 9, 10)}
    counting = {r.widget_id for r in A.lineage_edges(widgets, "counting").collect()}
    assert counting == {1, 2, 3, 9}  # a missing type counts as text here


def test_widget_statistics(boards):
    got = {r.widget_type: (r.widgets, r.without_query) for r in
           A.widget_statistics(A.flatten_widgets(boards)).collect()}
    assert got == {"chart": (6, 2), "text": (1, 0), "no_visualization": (2, 0), "unknown_type": (1, 0),
                   "total": (10, 2)}


def test_query_scores(boards, queries):
    edges = A.lineage_edges(A.flatten_widgets(boards))
    scored = {r.id: r for r in A.score_queries(A.query_features(queries, edges), AS_OF).collect()}
    assert scored.keys() == {10, 11, 13, 14, 15}
    assert (scored[10].downstream_dashboard_count, scored[10].downstream_chart_count) == (2, 3)
    assert scored[10].impact_score == pytest.approx(6) and scored[10].golden_query_score == pytest.approx(10)
    share = 0.8 * math.log(2) / math.log(3) + 0.2 * math.log(2) / math.log(4)
    assert scored[11].impact_score == pytest.approx(6 * share)
    assert [scored[i].curation_score for i in (10, 11, 13, 14)] == [1.0, 0.5, 0.5, 0.0]
    assert scored[13].recency_score == pytest.approx(3 * math.exp(-0.2))
    assert scored[14].recency_score == pytest.approx(3 * math.exp(0.2))  # ahead of time, not clamped
    assert scored[15].recency_score == 0.0 and scored[15].user_name == "c" and scored[10].user_name == "ann"
    for r in scored.values():
        assert 0 <= r.impact_score <= 6 + 1e-9
        assert r.golden_query_score == pytest.approx(r.impact_score + r.recency_score + r.curation_score)
    assert [r.id for r in A.top_queries(A.score_queries(A.query_features(queries, edges), AS_OF), 2).collect()] == [10, 11]


def test_query_scores_without_any_use(queries, boards):
    none = A.lineage_edges(A.flatten_widgets(boards)).where("false")
    assert {r.impact_score for r in A.score_queries(A.query_features(queries, none), AS_OF).collect()} == {0.0}


def test_dashboard_scores(spark, boards):
    widgets = A.flatten_widgets(boards)
    edges = A.lineage_edges(widgets)
    scores = spark.createDataFrame([(10, 4.0), (11, 1.0)], "id long, golden_query_score double")
    features = A.dashboard_features(boards)
    scored = A.score_dashboards(features, widgets, edges, scores, AS_OF)
    got = {r.id: r for r in scored.collect()}
    assert got.keys() == {1, 2, 3, 4}
    # queries count once per dashboard, an unscored query adds nothing
    assert got[1].content_quality_score == 7.0 and got[2].content_quality_score == pytest.approx(7 * 4 / 5)
    assert got[3].content_quality_score == 0.0
    assert [got[i].curation_score for i in (1, 2, 3, 4)] == [0.5, 1.0, 0.0, 0.0]
    assert [got[i].user_name for i in (1, 3, 4)] == ["ann", "bob", "Unknown"]
    assert got[1].is_draft is False and got[2].is_draft is True and got[1].tags == []
    assert got[1].recency_score == 2.0
    best = [(r.id, r.query_count) for r in A.top_dashboards(scored, 3).collect()]
    assert best == [(1, 3), (2, 1), (3, 0)]
    nothing = A.score_dashboards(features, widgets, edges, scores.where("false"), AS_OF)
    assert {r.content_quality_score for r in nothing.collect()} == {0.0}


def test_top_left_tie_takes_the_first_listed(spark):
    df = spark.createDataFrame([board(1, [widget(1, viz=False, text="", row=0, col=0),
                                          widget(2, viz=False, text="later", row=0, col=0)])], DASHBOARDS)
    assert A.description_scores(A.flatten_widgets(df)).first().curation_score == 0.5


def test_access_and_summaries(spark, boards, queries):
    edges = A.lineage_edges(A.flatten_widgets(boards))
    assert sorted(r.widget_id for r in A.accessible_widgets(edges, queries.where("id <> 10")).collect()) == [3, 8]
    assert sorted(r.query_id for r in A.orphan_queries(edges, queries.where("id = 10")).collect()) == [11, 13]
    assert A.lineage_summary(edges).first() == (3, 3, 2)
    assert A.asset_counts(boards, edges, queries).first() == (6, 5, 7)
    assert {r.dashboard_id: r.query_count for r in A.queries_per_dashboard(edges).collect()} == {1: 3, 2: 1}


def test_last_query_of_a_widget_wins(spark):
    edges = spark.createDataFrame([("w", 1, 10, 0), ("w", 1, 11, 3)],
                                  "widget_id string, dashboard_id int, query_id int, pos int")
    fetched = spark.createDataFrame([(10,)], "id int")
    assert A.accessible_widgets(edges, fetched).count() == 0


def test_score_distribution(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "s double")
    assert A.score_distribution(df, "s").first() == ("s", 1.0, 3.0, 2.0)


def test_nested_tables_are_made_after_their_rows_are_grouped(spark, folder):
    from tallyloom.plans import adapters as A
    rows = [(1, 10, 3, 2, "R"), (1, 11, 4, 1, "N"), (1, 11, 4, 1, "N"), (2, None, None, None, None), (2, 5, 1, 1, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                "l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    boards = A.nested_dashboards(A.Tables(spark, folder))
    got = {r.id: r.widgets for r in boards.collect()}
    assert [w.id for w in got[0]] == [11, 11, 10] and [w.id for w in got[1]] == [None, 5]
    assert got[0][0].options.position.row == 1 and got[0][2].options is None and got[0][2].visualization is None
    assert got[0][0].visualization.type == "chart" and got[0][0].visualization.query.id == 12
    results = {r.card_id: r.rows for r in A.nested_results(A.Tables(spark, folder)).collect()}
    assert results == {1: ["[1, 11, 1]", "[1, 11, 1]", '{"part": 10}'], 2: [None, "5"]}
    # Only the four columns travel, not the documents made of them.
    plan = boards._jdf.queryExecution().executedPlan().toString().split("\n")
    grouped = [line for line in plan if "partial_collect_list" in line]
    assert grouped and all("sizeX" not in line for line in grouped)
