"""Global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.operators.dedupe import path_order
from evisift.session import written

PARTITION_BITS = 33  # the row number inside a partition takes the low bits of the id


def numbered(rows: DataFrame, order: Sequence[Column], into: str = "position") -> DataFrame:
    """Number all rows from 1 in the given total order, and return them in that order's ranges.

    Rows are range-partitioned and sorted, written once, and every partition adds the
    number of rows before it. Ties in the leading keys do not pile up, as long as the
    last key is unique.
    """
    id_column = "_range_id"
    ranged = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(id_column, F.monotonically_increasing_id())
    )
    table = written(ranged, "numbered")
    part = F.shiftright(F.col(id_column), PARTITION_BITS)
    # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.col(id_column).bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    return (
        table.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(into, F.col("_offset") + within + 1)
        .drop("_part", "_offset", id_column)
    )


def candidate_order(
    eligible: str = "eligible", score: str = "total_hundredths",
    name: str = "candidate_name", file: str = "source_file",
) -> list[Column]:
    """Eligible rows by falling score, then the others, ties by name and file."""
    return [
        F.col(eligible).desc(),
        F.when(F.col(eligible), F.col(score)).desc_nulls_last(),
        F.lower(name).asc(),
        F.col(file).asc(),
    ]


def ranked(rows: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Add ``position`` over all rows and ``rank`` for the eligible ones."""
    placed = numbered(rows, order or candidate_order())
    return placed.withColumn("rank", F.when(F.col("eligible"), F.col("position")))


def first_in_path_order(files: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` files by path; 0 or NULL keeps all of them.

    Only paths are sorted and numbered, in parallel, whatever the limit.
    """
    if not limit:
        return files
    paths = files.select("source_file")
    order = path_order(F.col("source_file"))
    keyed = numbered(paths.withColumn("_at", order), [F.col("_at")])
    chosen = keyed.filter(F.col("position") <= limit).select("source_file")
    return files.join(chosen, "source_file", "left_semi")
