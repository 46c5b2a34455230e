"""Output tables of a run, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions.text import clip_words
from evisift.operators.scoring import CATEGORIES
from evisift.plans.screening import Report
from evisift.sources import ordered

REJECTED_SKILLS = 10
TOP_REASONS = 3
NO_PENALTIES = "No project-quality penalties"


def result_order() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.lower("candidate_name"), F.col("source_file")]


def in_order(results: DataFrame) -> DataFrame:
    """Ranked rows first, then the others by name."""
    return results.orderBy(*result_order())


def eligible_then_rejected(ranked: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both outputs as one table."""
    return ranked.unionByName(rejected, allowMissingColumns=True)


def flat(results: DataFrame) -> DataFrame:
    """The 16 columns of the CSV output."""
    b, d = F.col("score_breakdown"), F.col("deterministic_breakdown")
    delta = F.round(F.col("total_score") - F.col("deterministic_total_score"), 2)
    return results.select(
        "rank", "candidate_name", "eligible",
        F.col("deterministic_total_score").alias("det_total_score"),
        "total_score",
        delta.alias("llm_delta"),
        b["ai_project_depth"].alias("ai_project_depth"),
        d["ai_project_depth"].alias("ai_project_depth_deterministic"),
        *[b[c].alias(c) for c in CATEGORIES[1:]],
        F.array_join("matched_skills", "; ").alias("matched_skills"),
        F.array_join("rejection_reasons", "; ").alias("rejection_reasons"),
        "source_file",
    )


def shortlist(results: DataFrame, top: int) -> DataFrame:
    """The first ``top`` ranked rows with their scores before and after judging."""
    b, d = F.col("score_breakdown"), F.col("deterministic_breakdown")
    return (
        results.filter("eligible").orderBy("rank").limit(top).select(
            "rank", "candidate_name",
            F.col("deterministic_total_score").alias("det_total_score"), "total_score",
            F.round(F.col("total_score") - F.col("deterministic_total_score"), 2).alias("delta"),
            d["ai_project_depth"].alias("ai_project_depth_deterministic"),
            *[b[c].alias(c) for c in CATEGORIES],
        )
    )


def more_than(results: DataFrame, top: int) -> DataFrame:
    """How many eligible rows a list of ``top`` leaves out."""
    return results.agg(F.greatest(F.lit(0), F.count_if("eligible") - top).alias("more"))


def comparison(results: DataFrame) -> DataFrame:
    """One row per ranked document and category: baseline, refined and change."""
    b, d = F.col("score_breakdown"), F.col("deterministic_breakdown")
    pairs = [F.struct(F.lit(c).alias("category"), d[c].alias("baseline"), b[c].alias("refined")) for c in CATEGORIES]
    pairs.append(F.struct(
        F.lit("total").alias("category"), F.col("deterministic_total_score").alias("baseline"),
        F.col("total_score").alias("refined"),
    ))
    return results.filter("eligible").select("rank", "doc_id", F.inline_outer(F.array(*pairs))).withColumn(
        "change", F.round(F.col("refined") - F.col("baseline"), 2)
    )


def rejected(results: DataFrame, skills: int = REJECTED_SKILLS) -> DataFrame:
    """Documents without a rank, why, and the first ``skills`` that were found."""
    return results.filter(~F.col("eligible")).select(
        "doc_id", "candidate_name",
        F.array_join("rejection_reasons", "; ").alias("reasons"),
        F.array_join(F.slice("matched_skills", 1, skills), ", ").alias("skills"),
        "source_file",
    )


def top_reasons(results: DataFrame, top: int = 5, reasons: int = TOP_REASONS) -> DataFrame:
    """Why the first documents stand where they stand: activity (NULL where there is nothing to say), depth reasons and penalties."""
    rationale = F.col("score_breakdown")["rationale"]
    penalties = F.filter(rationale["penalties"], lambda r: ~r.contains(NO_PENALTIES))
    return results.filter("eligible").orderBy("rank").limit(top).select(
        "rank", "candidate_name", "total_score",
        clip_words(F.col("project_summary"), 240).alias("project"),
        F.when(F.length("github_summary") > 0, F.col("github_summary")).alias("activity"),
        F.slice(rationale["ai_project_depth"], 1, reasons).alias("reasons"),
        penalties.alias("penalties"),
    )


def write_json(report: Report, folder: str) -> None:
    """Nested results, in files whose order is that of the ranks, and the summary as JSON datasets."""
    ordered.write(report.results.drop("total_hundredths"), f"{folder}/candidates")
    report.summary.write.mode("overwrite").json(f"{folder}/summary")


def read_json(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """What :func:`write_json` wrote, checked against its manifest; from position ``first`` to ``last`` only, where given."""
    return ordered.read(spark, f"{folder}/candidates", first, last)


def write_csv(report: Report, folder: str) -> None:
    """The flat table in output order, NULL as blank."""
    in_order(flat(report.results)).write.mode("overwrite").csv(folder, header=True, nullValue="", escape='"')
