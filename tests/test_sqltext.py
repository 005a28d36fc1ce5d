import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import sqltext as Q
from tallyloom.operators import querylog as L
from tallyloom.operators import signatures as G


def one(spark, sql, expression):
    return spark.createDataFrame([(sql,)], "query string").select(expression(F.col("query"))).first()[0]


def shape(spark, sql):
    return one(spark, sql, Q.shape_text)


def signature(spark, sql, **options):
    df = spark.createDataFrame([(sql,)], "query string")
    return G.with_signature(df, **options).first()


def test_two_spellings_have_one_shape(spark):
    a = "SELECT  a, b FROM p.d.t_2024 -- note 'x'\nWHERE n >= 10.5 AND s = 'it''s' ;"
    b = "select a,b from p.d.t_2024 /* other */ where n>=7 and s='-- no comment'"
    assert shape(spark, a) == shape(spark, b) == "select a,b from p.d.t_2024 where n>=? and s=?"


def test_comment_marks_inside_literals_stay(spark):
    assert shape(spark, "select '/* a */', \"-- b\" from d.t") == "select ?,? from d.t"


def test_names_with_digits_stay(spark):
    assert shape(spark, "select x1, `c2 d` from d.t_2024 where y = 1e5") == (
        "select x1,`c2 d` from d.t_2024 where y=?")


def test_very_long_literal_and_comment(spark):
    sql = "select '" + "ab''" * 60_000 + "' /* " + "* x " * 60_000 + "*/ from d.t"
    assert shape(spark, sql) == "select ? from d.t"


def test_shape_id(spark):
    df = spark.createDataFrame([("select 1",), ("-- only a comment",), ("",), (None,)], "query string")
    ids = [r[0] for r in df.select(Q.shape_id(F.col("query"))).collect()]

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    assert ids == [sha("select ?"), sha("-- only a comment"), sha(""), sha("")]


def test_structure(spark):
    sql = """with a as (select x from d.t), b as (select 1)
      select a.x, row_number() over (partition by x order by y), sum(z) over w
      from a join b on true left join (select 2 from d.u) c on true group by x window w as (order by x)"""
    df = spark.createDataFrame([("k", sql)], "query_shape_id string, q string").select(
        "query_shape_id", Q.shape_text(F.col("q")).alias("normalized_sql"))
    row = L.with_structure(df).first()
    assert (row.join_count, row.cte_count, row.window_function_count, row.subquery_count,
            row.aggregation_presence) == (2, 2, 2, 3, True)
    assert row.raw_complexity_score == 2 + 4 + 6 + 3 + 1


def test_complexity_all_zero(spark):
    df = spark.createDataFrame([("k", "select ?")], "query_shape_id string, normalized_sql string")
    assert L.with_complexity(L.with_structure(df)).first().complexity_score == 0.0


def test_leaf_tables_skip_ctes_and_bare_names(spark):
    row = signature(spark, """with t as (select * from p.d.T1) select * from t
      join `p`.`d`.`t2` on true join x.t y on true join bare on true""")
    # x.t is qualified, so it is no reference to the CTE t.
    assert row.leaf_tables == ["d.t1", "d.t2", "x.t"]
    assert signature(spark, "select 1 from p.d.t", keep_catalog=True).leaf_tables == ["p.d.t"]


def test_join_edges(spark):
    row = signature(spark, """with c as (select 1) select * from d.b left outer join d.a on true
      cross join c full join d.z on true join (select 1) q on true""")
    assert row.join_edges == ["d.a|d.b|left"]


def test_aggregates_and_set_operators(spark):
    row = signature(spark, """select COUNT( DISTINCT a), count(*), Sum (x), summary(y) from d.t
      union all select 1 union distinct select 2 intersect select 3 except all select 4
      order by 1 limit 5""")
    assert row.agg_funcs == ["count", "count distinct", "sum"]
    assert row.set_ops == ["EXCEPT ALL", "INTERSECT", "UNION", "UNION ALL"]
    assert row.has_limit and row.has_order_by


@pytest.mark.parametrize("sql, window", [
    ("select 1 from d.t where dt >= '2024-01-01' and dt <= '2024-01-31'", "2024-01-01..2024-01-31"),
    ("select 1 from d.t where (dt between date '2024-01-01' and date '2024-01-31')", "2024-01-01..2024-01-31"),
    ("select 1 from d.t where dt >= cast('2024-01-01' as date) and dt <= DATE('2024-02-01')",
     "2024-01-01..2024-02-01"),
    ("select 1 from d.t where dt between cast('2024-01-01' as date) and '2024-01-05'", "2024-01-01..2024-01-05"),
    ("select 1 from d.t where dt >= '2024-01-01'", None),
    ("select 1 from d.t", None),
    # the lowest lower and the highest upper bound of one WHERE
    ("select 1 from d.t where dt >= '2024-01-05' and dt >= '2024-01-02' and dt <= '2024-01-09' "
     "and dt <= '2024-01-20'", "2024-01-02..2024-01-20"),
    # branches are intersected
    ("select 1 from d.t where dt between '2024-01-01' and '2024-01-20' union all "
     "select 2 from d.u where dt between '2024-01-10' and '2024-01-30'", "2024-01-10..2024-01-20"),
    ("select 1 from d.t where dt between '2024-01-01' and '2024-01-02' union all "
     "select 2 from d.u where dt between '2024-01-10' and '2024-01-30'", None),
    ("select 1 from d.t where dt between '2024-01-01' and '2024-01-02' union select 2 from d.u", None),
    # bounds inside CTEs and sub-queries do not count
    ("with a as (select 1 from d.t where dt between '2024-01-01' and '2024-01-02') select * from a", None),
    ("select * from d.t where x in (select y from d.u where dt between '2020-01-01' and '2020-01-02') "
     "and dt >= '2024-01-01' and dt <= '2024-01-02'", "2024-01-01..2024-01-02"),
    # a date in a comment or in HAVING does not count
    ("select 1 from d.t /* where dt >= '2024-01-01' */ where a = 1 having max(dt) <= '2024-01-01'", None),
])
def test_date_window(spark, sql, window):
    assert signature(spark, sql).date_window == window


def test_windows_intersect(spark):
    df = spark.sql("select array(struct('2024-01-01' low, '2024-01-09' high), "
                   "struct('2024-01-03' low, '2024-02-01' high)) w")
    assert df.select(Q.intersect_windows(F.col("w"))).first()[0] == "2024-01-03..2024-01-09"


def test_date_text(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-1-1",), ("x2024-01-01",), (None,)], "v string")
    assert [r[0] for r in df.select(Q.is_date_text(F.col("v"))).collect()] == [True, False, False, False]


def test_diff_pairs(spark):
    rows = [(1, "select a from d.t where x = 1", "SELECT a\nfrom d.t -- hi\nWHERE x = 1"),
            (2, "select a from d.t where x = 1", "select a from d.t where x = 2"),
            (3, "select a from d.t", "select a, a from d.u limit 3"),
            (4, "select 'A'", "select 'a'")]
    df = spark.createDataFrame(rows, "id int, left_query string, right_query string")
    got = {r.id: r for r in G.diff_pairs(df, "id").collect()}
    assert (got[1].text_equal, got[1].shape_equal, got[1].signature_equal) == (True, True, True)
    assert (got[1].tokens_added, got[1].tokens_removed) == (0, 0)
    assert (got[2].text_equal, got[2].shape_equal, got[2].signature_equal) == (False, True, True)
    assert got[3].changed_parts == ["leaf_tables", "has_limit"]
    assert (got[3].tokens_added, got[3].tokens_removed) == (5, 1)  # , a d.u limit 3 / d.t
    assert not got[4].text_equal and got[4].shape_equal


def test_compare_signature_tables(spark):
    left = G.with_signature(spark.createDataFrame([(1, "select a from d.t"), (2, "select 1")], "id int, query string"))
    right = G.with_signature(spark.createDataFrame([(1, "select a from d.u"), (3, "select 1")], "id int, query string"))
    got = {r.id: r for r in G.compare_signatures(left, right, "id").collect()}
    assert got[1].delta.keys() == {"leaf_tables"} and got[1].delta["leaf_tables"].golden == "d.t"
    assert not got[2].signature_equal and not got[3].signature_equal


def test_warehouse_names_comments_and_literals(spark):
    rows = [("a", "select 1 from `my-project-123.d.t` # comment from x.y"),
            ("b", "select 2 from `my-project-456.d.t`"),
            ("c", "select extract(year from e.dt), trim(both ' ' from x.y) from my-project-12.d.t limit @n"),
            ("d", "select a is distinct from b.c, 0x1F, .5, t.x - 7 from d.t"),
            ("e", "select * from d.a join (select k from d.x) s on a.k = s.k join d.b on b.k = s.k"),
            ("f", "select * from (select * from d.a left join d.b on a.k = b.k) s join d.c on 1 = 1")]
    df = spark.createDataFrame(rows, "id string, query string")
    got = {r.id: r for r in G.with_signature(df, shape="shape").collect()}
    assert got["a"].shape == "select ? from `my-project-123.d.t`"
    assert got["b"].shape == "select ? from `my-project-456.d.t`"
    assert got["a"].leaf_tables == ["d.t"] == got["c"].leaf_tables == got["d"].leaf_tables
    assert got["c"].has_limit and not got["a"].has_limit
    assert got["d"].shape == "select a is distinct from b.c,?,?,t.x-? from d.t"
    assert got["e"].join_edges == [] and got["e"].leaf_tables == ["d.a", "d.b", "d.x"]
    assert got["f"].join_edges == ["d.a|d.b|left"]


def test_date_window_below_deep_brackets(spark):
    deep = "(" * 12 + "x" + ")" * 12
    sql = (f"select * from t where a in (select f{deep} from u where dt >= '2020-01-01') "
           "and (dt >= date('2024-01-03')) and dt <= '2024-02-01' group by 1")
    df = spark.createDataFrame([(1, sql)], "id int, query string")
    assert G.with_date_window(df).first().date_window == "2024-01-03..2024-02-01"


@pytest.mark.parametrize("sql, tables, edges", [
    # comma joins, with and without aliases, beside other commas
    ("select a.x, b.y from d.a, d.b where a.k in (1, 2)", ["d.a", "d.b"], ["d.a|d.b|inner"]),
    ("select f(x, y) from d.a as a, d.b b join d.c on f(a, d.k) = 1, d.e order by x, d.z",
     ["d.a", "d.b", "d.c", "d.e"], ["d.a|d.b|inner", "d.b|d.c|inner", "d.c|d.e|inner"]),
    # paths into a row are no tables: of an alias, a table's own name, a CTE, an outer scope
    ("select * from d.orders o, o.items i, i.parts", ["d.orders"], []),
    ("select * from d.orders, orders.items left join d.b on true", ["d.b", "d.orders"], []),
    ("with c as (select 1) select * from c, c.items", [], []),
    ("select * from d.t t where exists (select 1 from t.tags g, d.u)", ["d.t", "d.u"], []),
    # a table named like its CTE, inside and outside of it
    ("with orders as (select * from d.orders) select * from orders join x.orders on true",
     ["d.orders", "x.orders"], []),
    # the partner after a sub-query in ON, in FROM, and in a group of joins
    ("select * from d.a join d.b on a.k in (select k from d.x) join d.c on true",
     ["d.a", "d.b", "d.c", "d.x"], ["d.a|d.b|inner", "d.b|d.c|inner"]),
    ("select * from d.a, (select k from d.x, d.y) s left join d.c on true",
     ["d.a", "d.c", "d.x", "d.y"], ["d.x|d.y|inner"]),
    ("select * from (d.a right join d.b using (k, l)) full outer join d.c on true",
     ["d.a", "d.b", "d.c"], ["d.a|d.b|right", "d.b|d.c|full"]),
    ("select * from ((select 1 from d.a) union all (select 2 from d.b)) u, d.c", ["d.a", "d.b", "d.c"], []),
    # calls in FROM are no tables; what they are called with is none either
    ("select * from d.t t, unnest(t.items) i, d.f(x.y) g cross join d.u", ["d.t", "d.u"], []),
    ("select * from d.t, lateral (select * from d.v, d.w) l, d.u",
     ["d.t", "d.u", "d.v", "d.w"], ["d.v|d.w|inner"]),
    # brackets, clause words and names inside literals
    ("select ')', '(select 1 from x.y', \"from x.z, x.w\" from d.a, d.b where c = ' union select * from q.r '",
     ["d.a", "d.b"], ["d.a|d.b|inner"]),
    ("select trim(both ' ' from x.y), a is distinct from b.c from d.a", ["d.a"], []),
    ("delete from d.t where k in (select k from d.u)", ["d.t", "d.u"], []),
    ("select count(*) d, max(x) from d.t", ["d.t"], []),
    ("insert into d.o (a, b) select * except (x, y) from d.t", ["d.t"], []),
])
def test_scopes(spark, sql, tables, edges):
    row = signature(spark, sql)
    assert (row.leaf_tables, row.join_edges) == (tables, edges)


@pytest.mark.parametrize("sql, window", [
    ("select 1 from d.t where note = 'no limit' and dt >= '2024-01-01' and dt <= '2024-01-31'",
     "2024-01-01..2024-01-31"),
    ("select 1 from d.t where note = 'x union y' and dt >= '2024-01-01' and dt <= '2024-01-31'",
     "2024-01-01..2024-01-31"),
    ("select 1 from d.t where note = ')) (select' and dt between '2024-01-01' and '2024-01-31'",
     "2024-01-01..2024-01-31"),
    ("select 1 from d.t where note = '>= ''2020-01-01''' and dt >= '2024-01-01' and dt <= '2024-01-31'",
     "2024-01-01..2024-01-31"),
    ("select 1 from d.t where x = '2020-01-01' and (dt >= '2024-01-01' or (y and dt <= timestamp('2024-01-31')))",
     "2024-01-01..2024-01-31"),
    # brackets around the branches
    ("(select 1 from d.t where dt between '2024-01-01' and '2024-01-20') union all "
     "(select 2 from d.u where dt between '2024-01-10' and '2024-01-30')", "2024-01-10..2024-01-20"),
    ("create table d.o as (select 1 from d.t where dt between '2024-01-01' and '2024-01-20')",
     "2024-01-01..2024-01-20"),
    ("select 1 from (select * from d.t where dt between '2020-01-01' and '2020-01-20') "
     "where dt between '2024-01-01' and '2024-01-20' order by dt >= '2010-01-01'", "2024-01-01..2024-01-20"),
    ("select 1 from d.t join d.u on dt >= '2024-01-01' and dt <= '2024-01-31'", None),
    ("select 1 from d.t where (dt >= '2024-01-01' and dt <= '2024-01-31'", None),
    ("select 1 from d.t where dt >= '2024-01-01') and dt <= '2024-01-31'", None),
])
def test_date_window_in_its_scope(spark, sql, window):
    assert signature(spark, sql).date_window == window


def test_set_operators_are_not_column_lists(spark):
    row = signature(spark, "select * except (a, b) from d.t except (select 1) except distinct select 2")
    assert row.set_ops == ["EXCEPT", "EXCEPT"]


def test_token_changes_count_multisets(spark):
    from collections import Counter
    texts = ["", "a", "a a a", "a b a", "b a a b", "a b c a b", "c a b a b c", "1 a '1 a' a", "select a , a , a from b , b"]
    rows = [(x, y) for x in texts for y in texts] + [("a", None), (None, None)]
    pairs = spark.createDataFrame(rows, "x string, y string")
    counted = G.token_changes(pairs, "x", "y", stripped=True)
    for r in counted.collect():
        if r.x is None or r.y is None:
            assert (r.text_equal, r.tokens_removed, r.tokens_added) == (None, None, None)
            continue
        x, y = ([t if t != "'1" else t for t in s.replace("'1 a'", "'1_a'").split()] for s in (r.x, r.y))
        assert (r.text_equal, r.tokens_removed, r.tokens_added) == (
            x == y, sum((Counter(x) - Counter(y)).values()), sum((Counter(y) - Counter(x)).values())), (r.x, r.y)
    # One comparison of what is left of both sides, not one for each side.
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and plan.count("array_intersect") == 1


def test_marks_are_told_from_the_text_between_them(spark):
    found = spark.createDataFrame([("select 1 from d.t,limit 5order by x",), ("select a from d.t where (b) limit 5",),
                                   ("select `\x01x\x02limit 1` from d.t order by 1",), (None,)], "q string").select(
        Q.marks(Q.dated(F.col("q"))).alias("m")).select(Q.has_limit(F.col("m")), Q.has_order_by(F.col("m")))
    assert [tuple(r) for r in found.collect()] == [(True, False), (True, False), (False, True), (None, None)]


def test_more_tasks_as_the_files_grow(spark, folder, monkeypatch):
    from tallyloom.functions import staging
    spark.range(1000).coalesce(1).write.parquet(f"{folder}/t")
    scan = spark.read.parquet(f"{folder}/t")
    cores = spark.sparkContext.defaultParallelism
    assert staging.spread(scan).rdd.getNumPartitions() == cores
    monkeypatch.setattr(staging, "PIECE", 200)
    dealt = staging.spread(scan)
    assert dealt.rdd.getNumPartitions() > cores and dealt.count() == 1000
