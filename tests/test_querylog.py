import hashlib
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import grouped as R
from tallyloom.operators import inventory as I
from tallyloom.operators import querylog as L
from tallyloom.plans import mining
from tallyloom.schemas import JOBS

T0 = datetime(2024, 1, 1)


def ref(table, dataset="d"):
    return {"project_id": "p", "dataset_id": dataset, "table_id": table}


def job(n, query, seconds, user="u", refs=(), dest=None, kind="SELECT", region="r"):
    at = T0 + timedelta(seconds=seconds)
    return (user, query, at, at, at, kind, list(refs), dest, str(n), region, "p", "QUERY", "DONE")


@pytest.fixture
def jobs(spark):
    rows = [
        job(1, "select 1 from d.once", 0, "solo"),
        job(2, "select 1 from d.twice", 0, "a", dest=ref("t_temp_x")),
        job(3, "select 2 from d.twice", 50, "b"),
        job(4, "select 1 from d.thrice", 0, "b", [ref("x")], ref("o1"), "INSERT"),
        job(5, "select 2 from d.thrice", 10, "a", [ref("y"), ref("x")], ref("o2"), "SELECT"),
        job(6, "select 3 from d.thrice", 40, "a", [ref("x")], ref("o2"), "SELECT"),
        job(7, "select 3 from d.tie", 5, "z", dest=ref("o1")),
        job(8, "select 4 from d.tie", 5, "y", dest=ref("o1")),
    ]
    return spark.createDataFrame(rows, JOBS)


def features(jobs):
    table = mining.golden_query_features(jobs, "2024-01-01 02:00:00")
    return {r.normalized_sql.split("d.")[-1]: r for r in table.collect()}


def test_features(jobs):
    f = features(jobs)
    assert f["once"].is_single_execution and f["once"].execution_regularity_stdev is None
    assert f["once"].regularity_hours == "SINGLE_EXECUTION"
    assert f["twice"].execution_regularity_stdev == 0.0 and f["twice"].regularity_hours == "0.00"
    assert f["thrice"].execution_regularity_stdev == pytest.approx(statistics.stdev([10, 30]))
    assert (f["thrice"].creator_first_seen_user, f["thrice"].primary_user_most_frequent_executor) == ("b", "a")
    assert f["thrice"].statement_type == "INSERT" and f["thrice"].is_dml
    assert f["thrice"].destination_table is None and not f["thrice"].has_persistent_destination
    assert f["thrice"].source_table_count == 2 and f["once"].source_table_count == 0
    assert f["twice"].destination_table == "p.d.t_temp_x" and f["twice"].is_temporary_write
    assert f["tie"].destination_table == "p.d.o1" and f["tie"].has_persistent_destination
    # ties: the lower name
    assert (f["tie"].creator_first_seen_user, f["tie"].primary_user_most_frequent_executor) == ("y", "y")
    assert f["tie"].execution_regularity_stdev == 0.0
    assert f["once"].hours_since_last_run == pytest.approx(2.0)


def test_result_does_not_depend_on_input_order(jobs):
    shuffled = jobs.orderBy(F.desc("job_id")).repartition(5)
    assert features(jobs) == features(shuffled)


def test_masking_once_gives_the_same_shapes(jobs):
    a = mining.shaped_jobs(jobs, mask_once=True, staged=False).select("job_id", "query_shape_id", "normalized_sql")
    b = mining.shaped_jobs(jobs, staged=False).select("job_id", "query_shape_id", "normalized_sql")
    assert sorted(a.collect()) == sorted(b.collect())


def test_export_lists_continue_in_segments(jobs):
    shaped = mining.shaped_jobs(jobs)
    whole = L.with_lists(L.query_features(shaped, "2024-01-02"), shaped, size=2)
    thrice = sorted((r for r in whole.collect() if r.normalized_sql.endswith("d.thrice")), key=lambda r: r.segment)
    assert [r.full_execution_history for r in thrice] == [
        ["2024-01-01T00:00:00.000000", "2024-01-01T00:00:10.000000"], ["2024-01-01T00:00:40.000000"]]
    assert sorted(thrice[0].list_of_distinct_users) == ["a", "b"] and thrice[1].list_of_distinct_users is None
    export = L.feature_export(whole)
    assert export.columns == L.FEATURE_COLUMNS
    text = {r.normalized_sql: r.execution_regularity_stdev for r in export.collect()}
    assert text["select ? from d.once"] == "SINGLE_EXECUTION"


def test_top_queries_and_coverage(jobs):
    top = [tuple(r) for r in L.top_raw_queries(jobs, 2).collect()]
    texts = sorted((r.query for r in jobs.collect()), key=lambda q: hashlib.sha256(q.encode()).hexdigest())
    assert top == [(q, 1) for q in texts[:2]]
    assert L.candidate_jobs(jobs, 1).count() == 1
    row = L.coverage_reduction(mining.shaped_jobs(jobs, staged=False)).first()
    assert (row.jobs, row.shapes, row.reduction_pct) == (8, 4, 50.0)


def test_gap_statistics_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for key, n, span in [("hot", 3000, 40_000), ("burst", 200, 3), ("same", 50, 1), ("few", 3, 10**6)]:
        rows += [(key, T0 + timedelta(microseconds=rng.randrange(span) * 250_000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {r.k: r for r in R.gap_statistics(df, ["k"], "ts", bucket_seconds=60).collect()}
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        assert got[key].runs == len(times) and got[key].gap_count == len(gaps)
        assert got[key].gap_mean == pytest.approx(statistics.mean(gaps))
        assert got[key].gap_stddev == pytest.approx(statistics.stdev(gaps))


def test_nearly_constant_gaps_keep_their_precision(spark):
    rows = [("k", T0 + timedelta(seconds=3600 * i, microseconds=(i * 7) % 5)) for i in range(500)]
    times = [t for _, t in rows]
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    got = R.gap_statistics(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts").first()
    assert got.gap_stddev == pytest.approx(statistics.stdev(gaps), rel=1e-5)


def test_numbering_and_previous_value_match_plain_windows(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(5000), i, f"v{rng.randrange(9)}")
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v string")
    bucket = F.floor(F.col("at") / 100)
    numbered = R.number_rows(df, ["k"], ["at", "id"], bucket)
    plain = df.selectExpr("k", "id", "row_number() over (partition by k order by at, id) position",
                          "lag(v) over (partition by k order by at, id) before")
    assert numbered.select("k", "id", "position").exceptAll(plain.select("k", "id", "position")).count() == 0
    previous = R.previous_value(df, ["k"], ["at", "id"], bucket, "v", "before")
    assert previous.count() == len(rows)
    assert previous.select("k", "id", "before").exceptAll(plain.select("k", "id", "before")).count() == 0


def test_distinct_counts_match_count_distinct(spark):
    rng = random.Random(7)
    rows = [("a" if rng.random() < .5 else "b", rng.randrange(30), rng.choice(["x", "y", None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    got = sorted(map(tuple, R.distinct_counts(df, ["k"], {"n1": "n", "s1": "s"}).collect()))
    want = sorted(map(tuple, df.groupBy("k").agg(F.countDistinct("n"), F.countDistinct("s")).collect()))
    assert got == want


def test_inventory(spark, jobs):
    names = ["t_20240101", "t_2024_01_01", "t_202401", "t", "t_2024", "t_12345678x"]
    tables = spark.createDataFrame([("US", "a", n) for n in names] + [("EU", "b", "t")],
                                   "region string, table_schema string, table_name string")
    assert sorted(r[0] for r in I.logical_tables(tables).collect()) == ["t", "t_12345678x", "t_2024"]
    assert I.logical_table_count(tables, by_dataset=True).first()[0] == 4
    datasets = spark.createDataFrame([("b", "EU"), ("a", None), ("c", "EU")], "dataset_id string, location string")
    assert {r.region: r.datasets for r in I.region_datasets(datasets).collect()} == {"US": ["a"], "EU": ["b", "c"]}
    assert I.tables_of_datasets(tables, datasets).count() == 7
    twice = jobs.unionByName(jobs.withColumn("region", F.lit("other")))
    assert I.unique_query_count(twice).first()[0] == 16
    assert I.unique_query_count(twice, global_distinct=True).first()[0] == 8
    assert I.inventory_counts(datasets, tables, jobs).first() == (3, 3, 8)
    assert I.unique_queries_by_region(jobs, approximate=True).first().unique_queries > 0


@pytest.mark.parametrize("n", [0, 1, 3, 7, 19, 40, 400, 5000])
def test_most_frequent_texts_with_ties(spark, n):
    rows = [(f"j{k}-{i}", f"select {k}") for k in range(300) for i in range((1, 1, 1, 2, 2, 9)[k % 6])]
    rows += [("none", None), ("again", None)]
    df = spark.createDataFrame(rows, "job_id string, query string")
    counts = Counter(q for _, q in rows)

    def digest(q):
        return hashlib.sha256(q.encode()).hexdigest() if q is not None else ""
    want = sorted(counts, key=lambda q: (-counts[q], digest(q)))[:n]
    assert [tuple(r) for r in L.top_raw_queries(df, n).collect()] == [(q, counts[q]) for q in want]
    assert {r.job_id for r in L.candidate_jobs(df, n).collect()} == {j for j, q in rows if q in set(want)}


def test_texts_are_chosen_without_being_sorted(spark, jobs):
    plan = L.raw_query_counts(jobs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    top = L.top_raw_queries(jobs, 1)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in top.splitlines() if "Exchange" in line and "hashpartitioning(query" in line]
    assert not exchanged
