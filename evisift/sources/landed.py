"""Landed snapshots of outside services: public activity and judgement responses.

Fetching is not Spark's work; each service's answers are landed as JSON lines and read with a fixed schema. Landed lines
are not to be trusted: some are cut short, hold a value of another type, or lack the key. ``read`` marks
each with its fault; the readers below give the sound rows, and ``land`` also writes the others to a quarantine
table, with the file they came from and the line as it was, so that they can be mended and landed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.operators.activity import parse_time
from evisift.session import written


@dataclass(frozen=True)
class Kind:
    """One service's lines: their fields, the field that every row needs, and those that are times."""

    name: str
    schema: str
    key: str
    times: tuple[str, ...] = ()


PROFILES = "username string, http_status int, public_repos int, error string"
EVENTS = "username string, created_at string"
REPOS = (
    "username string, name string, description string, language string, topics array<string>, "
    "fork boolean, pushed_at string"
)
RESPONSES = "doc_id string, response string"

PROFILE_LINES = Kind("profiles", PROFILES, "username")
EVENT_LINES = Kind("events", EVENTS, "username", ("created_at",))
REPO_LINES = Kind("repos", REPOS, "username", ("pushed_at",))
RESPONSE_LINES = Kind("responses", RESPONSES, "doc_id")

# What can be wrong with a line.
UNREADABLE, NO_KEY = "unreadable line", "no key"
QUARANTINE = "kind string, landed_file string, fault string, line string"


def read(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """The fields of a kind, ``landed_file``, ``fault`` (NULL: sound) and, where there is a fault, the ``line`` itself.

    A line that is no JSON object, or holds a value of another type than its field's, is unreadable as a whole. Fields that the
    schema doesn't name are left out; missing ones are NULL. A time that cannot be read becomes NULL and is no fault.
    """
    rows = (
        spark.read.schema(f"{kind.schema}, _line string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(path)
        .withColumn("landed_file", F.col("_metadata.file_path"))
    )
    fields = [c for c in rows.columns if c not in ("_line", "landed_file")]
    broken = F.col("_line").isNotNull()
    keyless = F.coalesce(F.length(F.col(kind.key).cast("string")), F.lit(0)) == 0
    marked = rows.withColumns({
        "fault": F.when(broken, UNREADABLE).when(keyless, NO_KEY),
        "line": F.when(broken, F.col("_line")).when(keyless, F.to_json(F.struct(*fields))),
    })
    return marked.select(
        *[parse_time(F.col(c)).alias(c) if c in kind.times else F.col(c) for c in fields], "landed_file", "fault", "line"
    )


def sound(rows: DataFrame) -> DataFrame:
    return rows.filter("fault IS NULL").drop("landed_file", "fault", "line")


def faulty(rows: DataFrame, kind: Kind) -> DataFrame:
    return rows.filter("fault IS NOT NULL").select(F.lit(kind.name).alias("kind"), "landed_file", "fault", "line")


def land(spark: SparkSession, path: str, kind: Kind, quarantine: str) -> DataFrame:
    """The sound rows of ``path``; the others are added to the quarantine folder as one batch.

    The lines are read once, and both outputs come from that reading.
    """
    rows = written(read(spark, path, kind), f"landed-{kind.name}")
    faulty(rows, kind).write.parquet(f"{quarantine.rstrip('/')}/kind_of={kind.name}/batch-{uuid.uuid4().hex}")
    return sound(rows)


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """``(kind, landed_file, fault, line)`` of all lines set aside so far."""
    return spark.read.schema(QUARANTINE).option("recursiveFileLookup", "true").parquet(quarantine)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return sound(read(spark, path, PROFILE_LINES))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events; a time that cannot be read becomes NULL."""
    return sound(read(spark, path, EVENT_LINES))


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return sound(read(spark, path, REPO_LINES))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return sound(read(spark, path, RESPONSE_LINES))
