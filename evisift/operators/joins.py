"""A left join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys held by at least ``hot_rows`` rows: at most ``rows / hot_rows`` of them."""
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= hot_rows)
        .select(key)
    )


def balanced_left_join(
    left: DataFrame, right: DataFrame, key: str, row_id: str, hot: DataFrame
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on a string ``key`` that is unique in ``right``.

    ``hot`` lists the keys held by many rows (:func:`hot_keys`), best counted on the
    table that ``left`` was derived from. The few partner rows of hot keys are broadcast. In the shuffled join that serves
    every other key, rows with a hot or NULL key get a key of their own, so they
    spread over all tasks and simply find no partner.
    """
    columns = [c for c in right.columns if c != key]
    partner = right.select(key, F.struct(*columns).alias("_partner"))
    hot_partner = partner.join(F.broadcast(hot), key, "left_semi")
    hot_side = hot.join(F.broadcast(hot_partner), key, "left").select(
        key, F.lit(True).alias("_hot"), F.col("_partner").alias("_hot_partner")
    )
    scattered = F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    marked = left.join(F.broadcast(hot_side), key, "left").withColumn(
        "_join_key",
        F.when(F.col("_hot") | F.col(key).isNull(), scattered).otherwise(F.col(key)),
    )
    joined = marked.join(partner.withColumnRenamed(key, "_join_key"), "_join_key", "left")
    chosen = F.coalesce("_hot_partner", "_partner")
    return joined.select(*left.columns, *[chosen[c].alias(c) for c in columns])
