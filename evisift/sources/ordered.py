"""JSON files whose order is that of their rows, with a manifest.

Spark promises no order of a table's files. ``write`` deals rows by ranges of their position, sorts each range and
gives every range its own file, so the files in the order of their names are the rows in theirs; no task gets more than its
range. The manifest says, for each file, which positions it holds and how many rows, and keeps the schema. A reader takes the files one by
one, or only those of some positions; ``read`` checks that nothing is missing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "file string, first bigint, last bigint, rows bigint"


def write(rows: DataFrame, folder: str, position: str = "position", files: int | None = None) -> None:
    """Write rows, numbered from 1 in ``position``, as JSON lines in ``folder``, in their order; the manifest stands beside it.

    ``files`` asks for about so many files; without it Spark sizes them.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    ranges = [position] if files is None else [files, position]
    dealt = rows.repartitionByRange(*ranges).sortWithinPartitions(position)
    dealt.write.mode("overwrite").json(folder, ignoreNullFields=False)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    back = spark.read.schema(f"{position} bigint").json(folder).select(name.alias("file"), position)
    listed = back.groupBy("file").agg(
        F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("rows")
    )
    # one row for each file
    listed.coalesce(1).sortWithinPartitions("first").write.mode("overwrite").json(f"{folder}.manifest")
    schema = spark.createDataFrame([(rows.schema.json(),)], "schema string")
    schema.coalesce(1).write.mode("overwrite").text(f"{folder}.schema")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}.manifest").orderBy("first")


def schema_of(spark: SparkSession, folder: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.text(f"{folder.rstrip('/')}.schema").first()[0]))


def check(spark: SparkSession, folder: str) -> None:
    """Files must follow each other without gap or overlap, in the order of their names."""
    files = manifest(spark, folder).collect()  # one row for each file
    expected = 1
    for entry in files:
        if entry["first"] != expected or entry["last"] - entry["first"] + 1 != entry["rows"]:
            raise ValueError(f"{folder}: rows from {expected} on are not where the manifest says: {entry}")
        expected = entry["last"] + 1
    if [f["file"] for f in files] != sorted(f["file"] for f in files):
        raise ValueError(f"{folder}: files are not named in the order of their rows")


def read(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None, position: str = "position") -> DataFrame:
    """The rows, or those from position ``first`` to ``last``, from the files that hold them."""
    folder = folder.rstrip("/")
    check(spark, folder)
    wanted = manifest(spark, folder)
    if first is not None:
        wanted = wanted.filter(F.col("last") >= first)
    if last is not None:
        wanted = wanted.filter(F.col("first") <= last)
    schema = schema_of(spark, folder)
    paths = [f"{folder}/{f['file']}" for f in wanted.collect()]
    rows = spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)
    if first is not None:
        rows = rows.filter(F.col(position) >= first)
    return rows if last is None else rows.filter(F.col(position) <= last)
