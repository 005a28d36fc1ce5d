"""Query mining end to end: history, shapes, features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.functions.staging import stage
from tallyloom.operators import querylog


def shaped_jobs(jobs: DataFrame, mask_once: bool = False, staged: bool = True) -> DataFrame:
    """Jobs with shapes.  Staged, each text is masked once however often the rows are used;
    the shape text repeats per row but is dictionary-encoded in the files."""
    shaped = querylog.with_shapes(querylog.flatten_jobs(jobs), mask_once)
    return stage(shaped, "shaped-jobs") if staged else shaped


def golden_query_features(jobs: DataFrame, as_of) -> DataFrame:
    return querylog.query_features(shaped_jobs(jobs), as_of)
