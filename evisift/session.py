"""Session helpers: sensible settings, and tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", name: str = "evisift", **conf: str) -> SparkSession:
    """A session for one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder.

    Where the session names none, a session on one machine gets a temporary folder that goes
    when the program ends. Several machines would not see each other's: that is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines of {master} share")
        folder = tempfile.TemporaryDirectory(prefix="evisift-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        folder = folder.name
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps then start from files that any executor can read again after a loss,
    and see only the columns they need.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def written_by_key(table: DataFrame, name: str, key: str) -> DataFrame:
    """Write a table to the shared folder in buckets of ``key`` and read it back.

    Joins and aggregations on the key then need no exchange of its rows. There are as many buckets as
    shuffle partitions, so what joins it is dealt the same way. The table is registered in the session's
    catalog under a name of its own.
    """
    spark = table.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{named}"
    table.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(named)
    return spark.table(named)
