"""Feature views refreshed from changes, and distinct counts from stored sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import inventory
from tallyloom.operators.features import FeatureGroup, feature_view
from tallyloom.streaming.serving import ServingTable

CLICKS = "user long, at timestamp, n long, name string"


def rows(rng, n, users, day):
    return [(rng.choice(users), f"2024-01-{day:02d} 00:00:{rng.randrange(60):02d}", rng.randrange(9),
             rng.choice(["x", None, "y"])) for _ in range(n)]


def frame(spark, found):
    return spark.createDataFrame(found, "user long, at string, n long, name string").withColumn(
        "at", F.col("at").cast("timestamp"))


def groups(spark, clicks, sales):
    return [FeatureGroup("clicks", frame(spark, clicks), ("user",), "at"),
            FeatureGroup("sales", frame(spark, sales), ("user",), "at")]


def same(a, b):
    key = lambda r: (r[0], str(r))
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_a_refresh_rewrites_what_changed_and_equals_the_rebuild(spark, folder):
    rng = random.Random(2)
    clicks, sales = rows(rng, 300, [*range(80), None], 2), rows(rng, 200, range(40, 120), 2)
    names = [["n", "name"], ["n"]]
    served = ServingTable(spark, f"{folder}/served", groups(spark, [], []), names, buckets=32)
    assert served.view().columns == ["entity_id", "clicks_n", "name", "sales_n"] and served.view().isEmpty()
    first = served.refresh({"clicks": frame(spark, clicks), "sales": frame(spark, sales)})
    same(served.view(), feature_view(groups(spark, clicks, sales), names))
    late = [*rows(rng, 5, [7, 900], 3), *rows(rng, 5, [7], 1)]  # Later, new, and behind the stored row.
    second = served.refresh({"clicks": frame(spark, late)})
    assert len(first) > 20 and 0 < len(second) <= 2
    whole = feature_view(groups(spark, clicks + late, sales), names)
    same(served.view(), whole)
    assert served.refresh({"clicks": frame(spark, late)}, batch=1) == second
    same(served.view(), whole)
    wanted = spark.createDataFrame([(7,)], "entity_id long")
    same(served.view(wanted).where("entity_id = '7'"), whole.where("entity_id = '7'"))
    assert served.refresh({"sales": frame(spark, [])}) == []
    same(served.view(), whole)


def test_new_files_only(spark, folder):
    rng = random.Random(4)
    clicks, late = rows(rng, 100, range(50), 2), rows(rng, 4, [3], 4)
    served = ServingTable(spark, f"{folder}/served", groups(spark, [], []), [["n"], ["name"]], buckets=8)
    for part in (clicks, late):
        frame(spark, part).write.mode("append").parquet(f"{folder}/in")
        served.follow("clicks", spark.readStream.schema(CLICKS).parquet(f"{folder}/in"), f"{folder}/seen")
    same(served.view(), feature_view(groups(spark, clicks + late, []), [["n"], ["name"]]))
    files = served.states.version().files
    assert sum(b == max(files.values()) for b in files.values()) == 1


def test_refused(spark):
    group = FeatureGroup("a", frame(spark, []), ("user",))
    with pytest.raises(ValueError):
        ServingTable(spark, "/nowhere", [group], [["n"]])
    with pytest.raises(ValueError):
        ServingTable(spark, "/nowhere", [group], [])


def test_sketches_are_merged_without_the_log(spark):
    jobs = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "eu").otherwise("us").alias("region"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 180 as int))").alias("creation_time"),
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("select "), F.col("id") % 20_000)).alias("query"))
    days = inventory.query_sketches(jobs)
    assert days.count() <= 360 and days.columns == ["region", "day", "sketch"]
    for keys, exact in ((["region"], inventory.unique_queries_by_region(jobs)),
                        ([], jobs.agg(F.countDistinct("query").alias("unique_queries")))):
        near = {r[:-1]: r[-1] for r in map(tuple, inventory.unique_from_sketches(days, keys).collect())}
        for r in map(tuple, exact.collect()):
            assert near[r[:-1]] == pytest.approx(r[-1], rel=0.03)
    part = inventory.unique_from_sketches(days, [], "2024-01-10", "2024-01-12").first()[0]
    want = jobs.where("to_date(creation_time) between '2024-01-10' and '2024-01-12'")
    assert part == pytest.approx(want.select("query").distinct().where("query is not null").count(), rel=0.03)
    assert inventory.unique_from_sketches(days.limit(0)).isEmpty()
