"""State tables that last: rows by key in hash buckets, of which a batch rewrites only those it touches.

``data/batch=<n>/bucket=<k>`` holds the rows of a bucket as batch n left them, ``versions/<n>.json`` which
folder each bucket is in after batch n.  A version is written when all its files are; a repeated batch
starts from the version before it, so it replaces what it wrote the first time.  The version before the
current one is kept, older files go, so a table has at most two files a bucket however long it is kept.
Cold keys cost nothing: they lie in buckets that no batch opens, and a late row finds them there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class Version:
    """Batch that made it (-1: none yet), batch of each bucket's files, and what the writer noted."""

    batch: int = -1
    files: dict[int, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


class StateTable:
    """A keyed table below ``path``; the number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str],
                 buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _version_path(self, batch: int):
        return self._path(f"{self.path}/versions/{batch:012d}.json")

    def version(self, before: int | None = None) -> Version:
        """The newest version, or the newest that a batch before ``before`` made."""
        folder = self._path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return Version()
        names = [str(f.getPath().getName()) for f in self._files.listStatus(folder)]
        batches = [int(n[:-5]) for n in names if n.endswith(".json")]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return Version()
        stream = self._files.open(self._version_path(max(batches)))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if told["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {told['buckets']} buckets, not {self.buckets}")
        return Version(max(batches), {int(k): b for k, b in told["files"].items()}, told["note"])

    def commit(self, batch: int, base: Version, touched: list[int], note: dict | None = None) -> Version:
        """Make what ``batch`` wrote the current version, and drop the one before ``base``."""
        new = Version(batch, base.files | {k: batch for k in touched}, note or {})
        text = json.dumps({"buckets": self.buckets, "files": new.files, "note": new.note})
        draft = self._path(f"{self.path}/versions/{batch:012d}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self._files.delete(self._version_path(batch), False)
        self._files.rename(draft, self._version_path(batch))
        old = self.version(base.batch) if base.batch >= 0 else Version()
        live = {*new.files.items(), *base.files.items()}
        for k, b in old.files.items():
            if (k, b) not in live:
                whole = b not in {x for _, x in live}
                self._files.delete(self._path(
                    f"{self.path}/data/batch={b}" + ("" if whole else f"/bucket={k}")), True)
        if old.batch >= 0:
            self._files.delete(self._version_path(old.batch), False)
        return new

    # ---- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that ``rows`` belong to; at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("k")).distinct().collect())

    def rows(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the current one), or only of some of its buckets."""
        version = version or self.version()
        wanted = [f"{self.path}/data/batch={b}/bucket={k}" for k, b in sorted(version.files.items())
                  if buckets is None or k in set(buckets)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def replace(self, batch: int, rows: DataFrame, touched: list[int]) -> DataFrame:
        """Write the new rows of the touched buckets; they are current once committed."""
        path = f"{self.path}/data/batch={batch}"
        (rows.withColumn("bucket", self.bucket()).repartition(max(len(touched), 1), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))
        return self.rows(Version(batch, {k: batch for k in touched}))


def fold_into(table: Callable[[SparkSession], StateTable], combine: Callable[[DataFrame], DataFrame],
              merge: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` sink that keeps a fold in a state table instead of a stream's state store.

    ``combine`` makes state rows of a batch, one a key; ``merge`` one state row of several of a key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        states = table(batch.sparkSession)
        base = states.version(batch_id)
        new = combine(batch).persist()
        try:
            touched = states.touched(new)
            if touched:
                states.replace(batch_id, merge(states.rows(base, touched).unionByName(new)), touched)
            states.commit(batch_id, base, touched)
        finally:
            new.unpersist()
    return write
