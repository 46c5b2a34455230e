"""Exact duplicates, and reuse of results that were already computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.operators.joins import balanced_left_join
from evisift.session import written

DUPLICATE = "duplicate"


def path_order(path: Column) -> Column:
    """Sort key of a path: by its parts, not by its characters."""
    return F.split(path, "/")


def copies(files: DataFrame) -> DataFrame:
    """``(content_hash, first_file, first_name, copies)`` of every content that occurs twice or more.

    Copies are counted before the shuffle, so a content with very many copies costs
    no more than one with two. The one aggregate says both which copy is the first and which contents are hot.
    """
    return (
        files.filter(F.length("content_hash") > 0)
        .groupBy("content_hash")
        .agg(
            F.min(F.struct(path_order(F.col("source_file")).alias("at"), "source_file", "filename")).alias("first"),
            F.count("*").alias("copies"),
        )
        .filter("copies > 1")
        .select(
            "content_hash",
            F.col("first.source_file").alias("first_file"),
            F.col("first.filename").alias("first_name"),
            "copies",
        )
    )


def with_first_copy(files: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``first_file`` and ``first_name`` where a content occurs twice or more, else NULL."""
    groups = written(copies(files.select("content_hash", "source_file", "filename")), "copies")
    hot = groups.filter(F.col("copies") >= hot_rows).select("content_hash")
    return balanced_left_join(files, groups.drop("copies"), "content_hash", "source_file", hot)


def is_later() -> Column:
    return F.col("first_file").isNotNull() & (F.col("first_file") != F.col("source_file"))


def duplicate_of(first_name: Column) -> Column:
    return F.concat(F.lit("duplicate of "), first_name)


def later_copies(files: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """The files that repeat an earlier one by path, with ``first_name``; a small table where copies are few.

    Give it narrow rows: whoever processes texts leaves these files out by an anti join first.
    """
    return with_first_copy(files, hot_rows).filter(is_later()).drop("first_file")


def mark_duplicates(files: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Give later copies the status ``duplicate`` and name the first file.

    The first path in order keeps its status; every row is kept. ``files`` needs
    ``source_file`` (unique), ``filename``, ``content_hash``, ``parse_status``, ``error``.
    """
    marked = with_first_copy(files, hot_rows)
    return marked.withColumns({
        "parse_status": F.when(is_later(), DUPLICATE).otherwise(F.col("parse_status")),
        "error": F.when(is_later(), duplicate_of(F.col("first_name"))).otherwise(F.col("error")),
    }).drop("first_file", "first_name")


def payload_key(*columns: str) -> Column:
    """The key of a request: a digest of its named values."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def pending(requests: DataFrame, done: DataFrame, *columns: str) -> DataFrame:
    """Distinct requests without a stored result: ``(key, columns)``."""
    keyed = requests.select(payload_key(*columns).alias("key"), *columns).distinct()
    return keyed.join(done.select("key").distinct(), "key", "left_anti")


def storable(results: DataFrame, succeeded: Column) -> DataFrame:
    """Only successes are kept for reuse, one per key."""
    return results.filter(succeeded).dropDuplicates(["key"])
