from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.tasks import custom_field_text, urgency

AS_OF = "2024-03-01 00:00:00"


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_iso_text(spark):
    df = texts(spark, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+05:30", "2024-01-01T00:00:00-05:30",
                       "2024-01-01T10:00:00", "2024-01-01", "junk", "", None, "2024", "2024-13-45"])
    got = column(df, F.date_format(S.parse_iso(F.col("v")), "yyyy-MM-dd HH:mm"))
    assert got == ["2024-01-01 00:00", "2023-12-31 18:30", "2024-01-01 05:30", "2024-01-01 10:00",
                   "2024-01-01 00:00", None, None, None, None, None]


def test_due_day_ends_at_midnight(spark):
    got = column(texts(spark, ["2024-03-01", "2024-03-01T08:00:00Z"]), S.parse_due(F.col("v")))
    assert got == [datetime(2024, 3, 1, 23, 59, 59), datetime(2024, 3, 1, 8)]


def test_urgency_floors_days(spark):
    due = ["2024-02-29T12:00:00Z", "2024-03-01T00:00:00Z", "2024-03-08T21:36:00Z",
           "2024-03-09T00:00:00Z", "nonsense", None, "2024-02-29"]
    # -0.5, 0, 7.9 and 8.0 days; a due day that ended one second ago is overdue.
    assert column(texts(spark, due), urgency(F.col("v"), AS_OF)) == [1.0, 0.5, 0.5, 0.0, 0.0, 0.0, 1.0]


def test_decay_is_not_clamped(spark):
    df = texts(spark, ["2024-02-28T00:00:00Z", "2024-03-11T00:00:00Z", None])
    past, future, none = column(df, S.decay(S.elapsed_days(AS_OF, S.parse_iso(F.col("v"))), 0.02, 3.0))
    assert past == pytest.approx(3 * 2.718281828459045 ** -0.04)
    assert future == pytest.approx(3 * 2.718281828459045 ** 0.2) and future > 3
    assert none == 0.0


def test_log_share_of_zero_maximum(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "i int, n int")
    assert {r[0] for r in S.with_maxima(df, "n").select(S.log_share(F.col("n"), F.col("_top.n"))).collect()} == {0.0}


def test_shorten(spark):
    assert column(texts(spark, ["x" * 50, "x" * 51]), S.shorten(F.col("v"), 50)) == [
        "x" * 50, "x" * 50 + "..."]


def test_sample_size():
    assert [S.clamp_sample_size(n) for n in (0, 2, 4, 9)] == [2, 2, 4, 5]


def test_present_id(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (2, None)], "i int, v long")
    assert column(df, S.present_id(F.col("v"))) == [False, True, False]


def test_custom_fields(spark):
    fields = [{"name": "A", "display_value": "d"}, {"name": "B", "display_value": "", "text_value": "t"},
              {"name": "C", "number_value": 0.0}, {"name": None, "text_value": None}]
    df = spark.createDataFrame([(fields,)], (
        "cf array<struct<name:string,display_value:string,text_value:string,number_value:double>>"))
    assert df.select(custom_field_text(F.col("cf"))).first()[0] == "A: d; B: t; C: 0.0; Unknown: (empty)"
