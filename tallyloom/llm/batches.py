"""How many rows go to Python at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes and rows of a batch: texts can be long, and a worker holds a batch and what it makes of it.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, with the session's batches for Python set to these sizes.

    A plan takes them when it runs, so they stay set: later Python steps of the session use them, too.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return rows


def free_name(rows: DataFrame, wanted: str) -> str:
    """A name for a column on the way that none of ``rows`` has, whatever they are called."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
