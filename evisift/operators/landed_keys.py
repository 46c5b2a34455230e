"""Landed tables hold what was fetched, in any order and perhaps more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that tell when a row was landed, if the table has one.
ARRIVAL = ("arrived_at", "fetched_at")


def of_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys``."""
    return table.join(keys.select(key), key, "left_semi")


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """One row for each key: the one that arrived last; of equal or unknown times, the greatest row.

    Rows compare column by column in the table's order, so the choice does not depend on how
    the rows are dealt out. Rows of a key are combined before the shuffle.
    """
    times = [c for c in ARRIVAL if c in table.columns]
    others = [c for c in table.columns if c != key and c not in times]
    last = table.groupBy(key).agg(F.max(F.struct(*times, *others)).alias("_last"))
    return last.select(*(F.col(key) if c == key else F.col("_last")[c].alias(c) for c in table.columns))
