"""The eligibility gate: decided from text evidence alone, before any enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons, in the order in which they are given.
NO_TEXT = "No extractable resume text"
NO_PYTHON = "No evidence of Python stack"
NO_AI = "No AI/agentic project evidence"
PROJECT_SOURCES = ["project", "experience"]
OK = "ok"


def shows_python(grp: Column) -> Column:
    return grp == "python"


def shows_ai(tier: Column, source: Column) -> Column:
    """A core term anywhere, or a general one in a project or a job."""
    return F.coalesce((tier == "core") | ((tier == "general") & source.isin(PROJECT_SOURCES)), F.lit(False))


def rejection_reasons(has_text: Column, has_python: Column, has_ai: Column) -> Column:
    return F.array_compact(F.array(
        F.when(~has_text, F.lit(NO_TEXT)),
        F.when(~has_python, F.lit(NO_PYTHON)),
        F.when(~has_ai, F.lit(NO_AI)),
    ))


def gate(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc_id, has_text, has_python, has_core, has_general_project, eligible, rejection_reasons)``.

    ``hits`` are term hits of content lines with ``grp``, ``tier`` and ``source``.
    """
    def ever(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    flags = hits.groupBy("doc_id").agg(
        ever(F.col("grp") == "python").alias("has_python"),
        ever(F.col("tier") == "core").alias("has_core"),
        ever((F.col("tier") == "general") & F.col("source").isin(PROJECT_SOURCES)).alias("has_general_project"),
    )
    texts = docs.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("has_text"))
    names = ["has_python", "has_core", "has_general_project"]
    joined = texts.join(flags, "doc_id", "left").fillna(False, names)
    has_ai = F.col("has_core") | F.col("has_general_project")
    return joined.select(
        "doc_id", "has_text", *names,
        (F.col("has_text") & F.col("has_python") & has_ai).alias("eligible"),
        rejection_reasons(F.col("has_text"), F.col("has_python"), has_ai).alias("rejection_reasons"),
    )


def unprocessed_reason(parse_status: Column, error: Column) -> Column:
    """The reason given for a document that was not processed at all."""
    return F.concat(
        F.lit("Resume not processed ("), parse_status, F.lit("): "), F.coalesce(error, parse_status)
    )
