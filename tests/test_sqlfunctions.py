"""The SQL functions against the column functions they stand for."""

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S
from tallyloom.functions import sqltext as Q
from tallyloom.functions.sqlfunctions import register_functions
from tallyloom.operators import assets, catalog, tasks

AS_OF = "2024-03-01T00:00:00"
TEXTS = [None, "", "0", "a", "{}", " [] ", '""', "2024-02-29", "2024-03-04", "2024-03-08T00:00:00Z", "2024-02-01T05:00:00+05:00",
         "2024", "junk", "model", "Metric", "RUNNING:7", "RUNNING:x", "done", "running", "failed", "gcp_x", "xgcp_",
         "task_requests_total", "a.TXT.gz", "b/.git/c.py", "dir/x.json", ".git/x", "org/repo", "org/", "long text " * 9,
         "select 1", "it''s", "a\nb", "é\\d"]
MOMENT = f"timestamp'{AS_OF}'"


def same():
    X, Y = F.col("x"), F.col("y")
    return {
        "parse_iso(x)": S.parse_iso(X), "parse_due(x)": S.parse_due(X),
        f"elapsed_days({MOMENT}, parse_iso(x))": S.elapsed_days(AS_OF, S.parse_iso(X)),
        f"elapsed_hours({MOMENT}, parse_iso(x))": S.elapsed_hours(AS_OF, S.parse_iso(X)),
        "decay(n, 0.02)": S.decay(F.col("n"), 0.02), "decay(n, 0.5, 3)": S.decay(F.col("n"), 0.5, 3.0),
        "log_share(n, 5)": S.log_share(F.col("n"), F.lit(5)), "log_share(n, 0)": S.log_share(F.col("n"), F.lit(0)),
        f"due_urgency({MOMENT}, x)": tasks.urgency(X, AS_OF),
        "is_present(x)": S.present(X), "is_present_json(x)": S.present_json(X), "is_present_id(x)": S.present_id(X),
        "shorten(x, 3)": S.shorten(X, 3), "is_date_text(x)": Q.is_date_text(X), "card_kind(x)": P.card_kind(X),
        "status_label(x, y)": P.status_label(X, Y), "progress_of(x)": P.progress_of(X),
        "is_exportable_metric(x)": P.is_exportable_metric(X),
        "safe_labels(map('tenant_id', x, 'k', x))": P.safe_labels(F.create_map(F.lit("tenant_id"), X, F.lit("k"), X)),
        "is_valid_pull_request(x, 'a', 'b', y, 'c', 'd')": P.is_valid_pull_request(
            X, *map(F.lit, "ab"), Y, *map(F.lit, "cd")),
        "is_valid_repository(x, y, 'a')": P.is_valid_repository(X, Y, F.lit("a")),
        "repository_key(x, y, 'o/r')": P.repository_key(X, Y, F.lit("o/r")),
        "repository_key(null, '', x)": P.repository_key(F.lit(None).cast("string"), F.lit(""), X),
        "is_countable_file('blob', x, n)": P.is_countable_file(F.lit("blob"), X, F.col("n")),
        "is_countable_file('blob', x, n, 1)": P.is_countable_file(F.lit("blob"), X, F.col("n"), 1),
        "is_countable_file(x, 'p', n)": P.is_countable_file(X, F.lit("p"), F.col("n")),
        "file_extension(x)": P.file_extension(X),
        "looks_like_text(cast(x as binary))": P.looks_like_text(X.cast("binary")),
        "looks_like_text(concat(cast(x as binary), x'00'))": P.looks_like_text(F.concat(X.cast("binary"), F.unhex(F.lit("00")))),
        "is_probably_text(x, cast(y as binary))": P.is_probably_text(X, Y.cast("binary")),
    }


@pytest.fixture(scope="module")
def texts(spark):
    register_functions(spark)
    rows = [(a, TEXTS[(i * 7 + 3) % len(TEXTS)], None if i % 5 == 0 else i % 4) for i, a in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "x string, y string, n long")


def test_scalars_equal_the_columns(texts):
    pairs = same()
    both = texts.select("x", "y", "n", *[F.struct(F.expr(sql).alias("sql"), column.alias("column")).alias(f"c{i}")
                                         for i, (sql, column) in enumerate(pairs.items())])
    for row in both.collect():
        for i, sql in enumerate(pairs):
            assert row[f"c{i}"].sql == row[f"c{i}"].column, (sql, row.x, row.y, row.n)


def test_signature_functions_equal_the_columns(spark, texts):
    queries = spark.createDataFrame([(q,) for q in [
        None, "", "select count( distinct a), Sum(b) from p.d.t -- max(x)\nlimit 3",
        "select 'limit 5 max(' from t union all select 1 UNION DISTINCT select min(a) from `x y` order by 1",
        'select "a\\"b", avg(x) from (select 1) order   by x except select 2']], "q string")
    marks = Q.marks(Q.dated(Q.canonical(F.col("q"))))
    for row in queries.withColumn("m", marks).select(
            F.expr("aggregate_functions(q)").alias("a"), Q.aggregate_functions(F.col("m")).alias("b"),
            F.expr("set_operators(q)").alias("c"), Q.set_operators(F.col("m")).alias("d"),
            F.expr("has_limit(q)").alias("e"), Q.has_limit(F.col("m")).alias("f"),
            F.expr("has_order_by(q)").alias("g"), Q.has_order_by(F.col("m")).alias("h")).collect():
        assert (row.a, row.c, row.e, row.g) == (row.b, row.d, row.f, row.h)


def test_dashboard_widgets_equal_the_operator(spark, texts):
    text = {"id": 3, "text": "t", "options": {"position": {"row": 2, "col": 1}}}
    chart = {"id": 4, "visualization": {"type": None, "query": {"id": 9}}}
    boards = spark.createDataFrame([
        {"id": 1, "widgets": [text, chart, {"id": None}]}, {"id": 2, "widgets": []}, {"id": 3, "widgets": None},
        {"id": 0, "widgets": [text]}, {"id": None, "widgets": [text]}], schemas.DASHBOARDS)
    told = spark.sql("SELECT w.* FROM {b} b, LATERAL dashboard_widgets(b.id, b.widgets) w", b=boards)
    want = assets.flatten_widgets(boards)
    assert told.columns == want.columns
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect())) and told.count() == 3


def test_result_rows_equal_the_operator(spark, texts):
    results = spark.createDataFrame([
        (1, ["a", "b", "a"], ["[1, 2, 3]", '{"k": "v"}', "7", "[1]", None]), (2, [], ["[1]"]), (3, ["a"], None),
        (4, ["a"], [])], "card_id long, cols array<string>, rows array<string>")
    told = spark.sql("SELECT c.card_id, r.* FROM {c} c, LATERAL result_rows(c.cols, c.rows, 4) r", c=results)
    want = catalog.sample_results(results, 4).select("card_id", F.posexplode("rows").alias("p", "r"))
    assert sorted((r.card_id, r.row_number - 1, str(r.fields)) for r in told.collect()) == sorted(
        (r.card_id, r.p, str(r.r)) for r in want.collect())
    assert told.where("card_id = 1").count() == 4


def test_default_number_of_rows(spark, texts):
    assert spark.sql("SELECT * FROM result_rows(array('a'), array_repeat('[1]', 30))").count() == catalog.ROW_SAMPLE


def test_table_functions_do_not_join_rows_to_themselves(spark, texts):
    """Neither nested widgets nor texts are shuffled as keys; each text is read once."""
    boards = spark.createDataFrame([{"id": 1, "widgets": [{"id": 7}]}] * 2, schemas.DASHBOARDS)
    told = spark.sql("SELECT w.* FROM {b} b, LATERAL dashboard_widgets(b.id, b.widgets) w", b=boards)
    queries = spark.createDataFrame([(1, "select count(a) from t limit 1"), (1, None)], "id int, q string")
    parts = spark.sql("SELECT id, s.* FROM {q} q, LATERAL signature_parts(q.q) s", q=queries)
    for df, rows in ((told, 2), (parts, 8)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and df.count() == rows
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(lower(") <= 1
