"""A store of results by key, so that a second run asks only for what it doesn't have.

A store is a folder of *batches*. Each append writes one batch, its rows split into ``buckets`` subfolders by a hash of
the key, and counts as soon as Spark's commit marker of the batch is there: readers see a batch whole or not at
all, and an append that failed leaves nothing to be seen. Appends don't touch each other, so any number can
run at a time.

A lookup finds out which buckets the wanted keys fall into (at most ``buckets`` numbers) and reads no others. Where a key
was stored more than once, the first batch counts. ``compacted`` copies a store that has grown many batches into a new one.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_SUCCESS"


@dataclass(frozen=True)
class ResultStore:
    """``columns`` is the schema of a result besides ``key string``; a store keeps its number of buckets for life."""

    spark: SparkSession
    folder: str
    columns: str
    buckets: int = 256

    def _bucket(self, key: str = "key"):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def batches(self) -> list[str]:
        """The committed batches, oldest first."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/batch-*/{MARKER}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def append(self, results: DataFrame) -> str | None:
        """Add results as one batch; returns its folder, or None where there was nothing to add."""
        names = self.spark.createDataFrame([], f"key string, {self.columns}").columns
        rows = results.filter("key IS NOT NULL").select(*names).withColumn("bucket", self._bucket())
        # a bucket's rows meet in one task each, so a batch has at most one file for each bucket
        path = f"{self.folder.rstrip('/')}/batch-{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return path

    def table(self, wanted: DataFrame | None = None) -> DataFrame:
        """``key``, the columns, and ``batch`` (number from 0); with ``wanted(key)``, only the buckets its keys fall into."""
        schema = f"key string, {self.columns}, bucket int"
        parts = self.batches()
        rows = self.spark.createDataFrame([], f"{schema}, batch int")
        if parts:
            # the batches are named, so that one that isn't committed is never listed
            read = [self.spark.read.schema(schema).parquet(p).withColumn("batch", F.lit(n)) for n, p in enumerate(parts)]
            rows = read[0]
            for more in read[1:]:
                rows = rows.unionByName(more)
            if wanted is not None:
                asked = [r[0] for r in wanted.filter("key IS NOT NULL").select(self._bucket()).distinct().collect()]
                rows = rows.filter(F.col("bucket").isin(asked)) if asked else rows.limit(0)
        return rows.drop("bucket")

    def results(self, wanted: DataFrame | None = None) -> DataFrame:
        """One row per key, that of the first batch that has it; with ``wanted(key)``, for these keys alone."""
        rows = self.table(wanted)
        if wanted is not None:
            rows = rows.join(wanted.select("key").distinct(), "key", "left_semi")
        values = [c for c in rows.columns if c not in ("key", "batch")]
        first = rows.groupBy("key").agg(F.min_by(F.struct(*values), "batch").alias("found"))
        return first.select("key", "found.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The distinct rows of ``wanted(key, ...)`` whose key has no stored result."""
        return wanted.distinct().join(self.table(wanted).select("key"), "key", "left_anti")

    def compacted(self, folder: str) -> ResultStore:
        """A new store of one batch with the first result of every key."""
        new = ResultStore(self.spark, folder, self.columns, self.buckets)
        new.append(self.results())
        return new
