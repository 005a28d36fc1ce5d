"""Every registered query against its SQL on DuckDB."""

import os

import pytest

import __spark_entry__ as entry
import oracle_compare
from tallyloom.plans.catalogue import QUERIES
from tallyloom.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle_compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert oracle_compare.difference(df, duck, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert unwanted not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
