import csv
import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import staging
from tallyloom.functions.sqlfunctions import register_functions
from tallyloom.operators import assets, features
from tallyloom.sources import scans, sinks

T0 = datetime(2024, 1, 1)


def job(n, region, start, kind="QUERY", state="DONE", project="p"):
    return ("u", "select 1", start, start, start, None, [], None, str(n), region, project, kind, state)


def test_job_scan_pushes_its_filters_down(spark, folder):
    rows = [job(1, "a", datetime(2024, 1, 10)), job(2, "a", datetime(2023, 1, 10)), job(3, "b", T0, kind="LOAD"),
            job(4, "b", T0, state="RUNNING"), job(5, "b", T0, project="q"), job(6, "b", T0)]
    spark.createDataFrame(rows, schemas.JOBS).write.partitionBy("region").parquet(folder + "/jobs")
    scan = scans.finished_queries(scans.read_jobs(spark, folder + "/jobs"), "p", datetime(2024, 2, 1))
    assert sorted(r.job_id for r in scan.collect()) == ["1", "6"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = scan.where("region = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan
    for pushed in ("EqualTo(job_type,QUERY)", "EqualTo(state,DONE)", "GreaterThanOrEqual(start_time", "EqualTo(project_id,p)"):
        assert pushed in plan


def test_damaged_region_is_left_out(spark, folder):
    jobs = spark.createDataFrame([job(1, "a", T0), job(2, "b", T0)], schemas.JOBS)
    jobs.coalesce(1).write.partitionBy("region").parquet(folder + "/jobs")
    (path,) = glob.glob(folder + "/jobs/region=b/*.parquet")
    with open(path, "wb") as out:
        out.write(b"not parquet at all")
    crc = os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc")
    os.replace(crc, crc + ".old")
    with pytest.raises(Exception):
        scans.read_jobs(spark, folder + "/jobs").collect()
    assert [r.job_id for r in scans.read_jobs(spark, folder + "/jobs", True).collect()] == ["1"]
    (lost,) = scans.unread_files(spark, folder + "/jobs").collect()
    assert lost.file.endswith(os.path.basename(path)) and lost.size == 18


def test_files_damaged_half_way_are_listed(spark, folder):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("query"),
                                      F.col("id").cast("string").alias("job_id"))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in rows.columns else F.col(f.name)
               for f in spark.createDataFrame([], schemas.JOBS).schema]
    path = f"{folder}/jobs"
    whole = rows.select(*columns)
    whole.coalesce(1).write.option("parquet.block.size", 1 << 16).option("parquet.page.size", 1 << 13).parquet(path)
    whole.limit(0).coalesce(1).write.mode("append").parquet(path)
    whole.limit(5).coalesce(1).write.mode("append").parquet(path)
    for crc in glob.glob(f"{path}/.*.crc"):
        os.replace(crc, crc + ".old")
    big = max(glob.glob(f"{path}/*.parquet"), key=os.path.getsize)
    with open(big, "r+b") as out:
        out.seek(os.path.getsize(big) // 2)
        out.write(b"\xff" * 4096)
    read = scans.read_jobs(spark, path, True).count()
    (lost,) = scans.unread_files(spark, path).collect()
    assert lost.file.endswith(os.path.basename(big)) and lost.rows == 40_000 and 0 < lost.read < 40_000
    assert read <= 40_005


def test_entities_that_hold_the_joiner(spark):
    left = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2), ("a\\", "|b", 3)], "x string, y string, n int")
    right = spark.createDataFrame([("a", "b|c", 9)], "x string, y string, m int")
    view = features.feature_view([features.FeatureGroup("l", left, ("x", "y")),
                                  features.FeatureGroup("r", right, ("x", "y"))], [["n"], ["m"]])
    assert sorted(map(tuple, view.collect())) == [
        ("a\\\\|\\|b", 3, None), ("a\\|b|c", 1, None), ("a|b\\|c", 2, 9)]


def test_pages_and_details(spark, folder):
    for i, items in enumerate([[{"id": 1, "name": "a"}, {"id": 2}], [], [{"id": 3}]]):
        with open(f"{folder}/page{i}.json", "w") as out:
            json.dump({"count": 3, "results": items}, out, indent=1)
    listed = scans.read_pages(spark, folder, "id long, name string")
    assert sorted(r.id for r in listed.collect()) == [1, 2, 3]
    details = spark.createDataFrame([(1, "x"), (3, "y"), (7, "z")], "id long, body string")
    assert sorted(r.id for r in scans.fetched(listed, details).collect()) == [1, 3]
    assert [r.id for r in scans.not_fetched(listed, details).collect()] == [2]
    assert scans.all_regions(listed, listed.where("false"), listed).count() == 6


def test_nested_documents(spark, folder):
    with open(f"{folder}/d.json", "w") as out:
        out.write(json.dumps({"id": 1, "widgets": [{"id": 5, "visualization": {"type": "chart", "query": {"id": 9}}}]}))
    boards = scans.read_documents(spark, folder, schemas.DASHBOARDS)
    assert [tuple(r)[:3] for r in assets.lineage_edges(assets.flatten_widgets(boards)).collect()] == [(1, 5, 9)]


def read_csv(path):
    rows = []
    for name in sorted(glob.glob(path + "/part-*.csv")):
        with open(name) as source:
            text = source.read()
            rows += list(csv.reader(text.splitlines(keepends=True)))
    return text, rows


def test_quoted_csv(spark, folder):
    df = spark.createDataFrame([(1, 'say "hi",\nthere', ["a", "b"])], "id int, query string, tags array<string>")
    sinks.write_csv(df.coalesce(1), folder + "/csv", ["query", "missing", "id", "tags"])
    text, rows = read_csv(folder + "/csv")
    assert rows == [["query", "id", "tags"], ['say "hi",\nthere', "1", '["a","b"]']]
    assert text.startswith('"query","id","tags"')


def test_sorted_csv_keeps_its_order(spark, folder):
    df = spark.range(1000).withColumn("golden_query_score", F.col("id") * 7 % 1000)
    sinks.write_csv(assets.ranked_queries(df), folder + "/csv", ["id", "golden_query_score"])
    _, rows = read_csv(folder + "/csv")
    scores = [int(r[1]) for r in rows if r[0] != "id"]
    assert scores == sorted(scores, reverse=True) and len(scores) == 1000


def test_records_and_dump(spark, folder):
    df = spark.createDataFrame([(1, None, T0)], "id int, v string, t timestamp")
    sinks.write_records(df.coalesce(1), folder + "/json")
    (name,) = glob.glob(folder + "/json/part-*.json")
    with open(name) as source:
        assert json.loads(source.read()) == {"id": 1, "v": None, "t": "2024-01-01T00:00:00.000Z"}
    sinks.write_records(df.where("false"), folder + "/none")
    assert os.path.exists(folder + "/none/_SUCCESS")
    lines = spark.createDataFrame([("cards", "list", 1, "{}"), ("cards", "result", 1, "{}"), ("models", "list", 2, "{}")],
                                  schemas.DUMP_LINE)
    for _ in range(2):  # a second run replaces the first
        sinks.write_dump(lines, folder + "/dump")
    assert len(glob.glob(folder + "/dump/artifact=cards/*.json")) == 1
    assert spark.read.json(folder + "/dump").count() == 3


def test_summaries(spark):
    a, b = spark.range(3), spark.range(5)
    assert sinks.phase_summary({"a": a, "b": b}, seconds=1.5).first() == (3, 5, 1.5)
    df = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 2.0)], "name string, score double")
    best = sinks.best_names(df.orderBy(F.desc("score")), "name", "score", 2).first().best
    assert [(r.name, r.score) for r in best] == [("y", 3.0), ("z", 2.0)]


def test_feature_views(spark):
    a = spark.createDataFrame([(1, 10, 5), (2, 20, 6)], "user_id long, x int, y int")
    b = spark.createDataFrame([("2", 0.5), ("3", 0.7)], "cust string, z double")
    groups = [features.FeatureGroup("ga", a, ("user_id",)), features.FeatureGroup("gb", b, ("cust",))]
    view = features.feature_view(groups, [["x"], ["z"]])
    assert sorted(map(tuple, view.collect())) == [("1", 10, None), ("2", 20, 0.5), ("3", None, 0.7)]
    with pytest.raises(ValueError):
        features.feature_view(groups, [["x"]])
    with pytest.raises(ValueError):
        features.FeatureGroup("g", a, ())
    with pytest.raises(ValueError):
        features.FeatureGroup("g", a, ("nope",))
    wanted = spark.createDataFrame([("2",), ("9",)], "entity_id string")
    assert {r.entity_id: (r.found, r.x) for r in features.lookup(view, wanted).collect()} == {
        "2": (True, 20), "9": (False, None)}
    doubled = features.FeatureGroup("g", a.unionByName(a.where("user_id = 1")), ("user_id",))
    assert [tuple(r) for r in features.duplicate_entities(doubled).collect()] == [(1, 2)]
    request = spark.createDataFrame([(([("gb", ["z"]), ("ga", ["y", "x"])],), ("0 * * * *",))],
                                    schemas.FEATURE_VIEW_REQUEST)
    built = features.view_from_request(request, {g.name: g for g in groups})
    assert built.columns == ["entity_id", "z", "y", "x"]


def test_feature_view_has_a_row_per_entity(spark):
    a = spark.createDataFrame([(1, "u", 1, 10), (1, "u", 2, 20), (1, "v", 1, 30), (None, "u", 1, 40)],
                              "org long, user string, at int, x int")
    b = spark.createDataFrame([("1|u", 7), ("1|u", 5)], "key string, x int")
    groups = [features.FeatureGroup("ga", a, ("org", "user"), "at"), features.FeatureGroup("gb", b, ("key",))]
    view = features.feature_view(groups, [["x"], ["x"]])
    assert view.columns == ["entity_id", "ga_x", "gb_x"]
    assert sorted(map(tuple, view.collect())) == [("1|u", 20, 7), ("1|v", 30, None)]


def test_feature_view_materialises(spark, folder):
    a = spark.createDataFrame([(1, 10)], "user_id long, x int")
    view = features.feature_view([features.FeatureGroup("a", a, ("user_id",))], [["x"]])
    for _ in range(2):
        features.materialise(view, folder + "/view")
    assert [tuple(r) for r in spark.read.parquet(folder + "/view").collect()] == [("1", 10)]


def test_staging_uses_the_folder_of_the_session(spark):
    assert staging.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert staging.stage(spark.range(3), "t").inputFiles()[0].startswith(
        "file://" + staging.shared_folder(spark))


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("""select query_shape('SELECT 1 -- x') s, query_shape_id('select 2') i, is_dml('merge') d,
      is_temporary_write('p.tmp.temp_1') t, is_service_account('a@b.iam.gserviceaccount.com') a,
      logical_table_name('t_20240101') l, raw_complexity(1, 1, 1, 1, true) c""").first()
    assert (row.s, row.d, row.t, row.a, row.l, row.c) == ("select ?", True, True, True, "t", 8)
    import hashlib
    assert row.i == hashlib.sha256(b"select ?").hexdigest()
