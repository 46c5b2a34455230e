"""Judgements of projects made outside Spark, landed as raw response texts.

A response is parsed as VARIANT, so a malformed one is a row with a warning and never
a failed job. One violation rejects the whole response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import clipped, squeeze, strip, word_count
from evisift.operators.landed_keys import one_per_key
from evisift.operators.projects import DOMAINS, SIGNAL_TYPE, SIGNALS
from evisift.params import Limits

FENCE = "```"
PROJECT_TYPE = (
    "struct<name:string,description:string,technologies:array<string>,domain:string,"
    "quality_score:double,quality_rationale:string,cited_evidence:string,"
    f"signals:{SIGNAL_TYPE},is_thin_wrapper:boolean,is_tutorial:boolean>"
)
# Texts that stand for a flag, and the range of a quality score.
TRUE_TEXTS = ["true", "1", "t", "y", "yes", "on"]
FALSE_TEXTS = ["false", "0", "f", "n", "no", "off"]
QUALITY_RANGE = (0.0, 10.0)
NAME_WORDS = 5


def unfenced(response: Column) -> Column:
    """The response without a surrounding code fence."""
    text = strip(response)
    inside = F.regexp_replace(F.get(F.split(text, FENCE, 3), F.lit(1)), "^json", "")
    return F.when(text.startswith(FENCE), strip(inside)).otherwise(text)


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """The type of a variant in words, NULL for a missing one."""
    return F.schema_of_variant(value)


def text_of(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def flag_of(value: Column, name: str) -> Column:
    text = F.lower(text_of(value, name))
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)


def absent_or(value: Column, name: str, accepted: Column) -> Column:
    return member(value, name).isNull() | F.coalesce(accepted, F.lit(False))


def is_kind(value: Column, name: str, *kinds: str) -> Column:
    return kind(member(value, name)).isin(*kinds)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def valid_project(p: Column) -> Column:
    score = F.try_variant_get(p, "$.quality_score", "double")
    found = member(p, "signals")
    checks = [
        is_object(p),
        F.coalesce(is_kind(p, "name", "STRING"), F.lit(False)),
        F.coalesce(is_kind(p, "description", "STRING"), F.lit(False)),
        absent_or(p, "technologies", is_kind(p, "technologies", "ARRAY<STRING>", "ARRAY<VOID>")
                  & ~F.exists(F.try_variant_get(p, "$.technologies", "array<string>"), lambda t: t.isNull())),
        absent_or(p, "domain", is_kind(p, "domain", "STRING") & text_of(p, "domain").isin(DOMAINS)),
        absent_or(p, "quality_score", score.between(*QUALITY_RANGE)),
        absent_or(p, "quality_rationale", is_kind(p, "quality_rationale", "STRING")),
        absent_or(p, "cited_evidence", is_kind(p, "cited_evidence", "STRING")),
        absent_or(p, "is_thin_wrapper", flag_of(p, "is_thin_wrapper").isNotNull()),
        absent_or(p, "is_tutorial", flag_of(p, "is_tutorial").isNotNull()),
        absent_or(p, "signals", is_object(found)),
        *[absent_or(p, f"signals.{s.name}", flag_of(p, f"signals.{s.name}").isNotNull()) for s in SIGNALS],
    ]
    valid = checks[0]
    for check in checks[1:]:
        valid = valid & check
    return valid


def trimmed_names(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda t: F.length(t) > 0)


def normal_project(p: Column, limits: Limits) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        clipped(strip(text_of(p, "name")), limits.title).alias("name"),
        clipped(strip(text_of(p, "description")), limits.judged_description).alias("description"),
        F.array_sort(F.array_distinct(trimmed_names(
            F.coalesce(F.try_variant_get(p, "$.technologies", "array<string>"), none)
        ))).alias("technologies"),
        F.coalesce(text_of(p, "domain"), F.lit("unknown")).alias("domain"),
        F.coalesce(F.try_variant_get(p, "$.quality_score", "double"), F.lit(0.0)).alias("quality_score"),
        F.nullif(text_of(p, "quality_rationale"), F.lit("")).alias("quality_rationale"),
        F.nullif(text_of(p, "cited_evidence"), F.lit("")).alias("cited_evidence"),
        F.struct(*[
            F.coalesce(flag_of(p, f"signals.{s.name}"), F.lit(False)).alias(s.name) for s in SIGNALS
        ]).alias("signals"),
        F.coalesce(flag_of(p, "is_thin_wrapper"), F.lit(False)).alias("is_thin_wrapper"),
        F.coalesce(flag_of(p, "is_tutorial"), F.lit(False)).alias("is_tutorial"),
    ).cast(PROJECT_TYPE)


def parsed(responses: DataFrame) -> DataFrame:
    """Add ``_value`` (VARIANT) and ``failure``: why a response is not a JSON object, or NULL."""
    value = responses.withColumn("_value", F.try_parse_json(unfenced(F.col("response"))))
    return value.withColumn(
        "failure",
        F.when(F.coalesce(F.length("response"), F.lit(0)) == 0, F.lit("empty response from model"))
        .when(F.col("_value").isNull(), F.lit("response was not valid JSON"))
        .when(~is_object(F.col("_value")), F.lit("expected a JSON object at the top level")),
    )


def _with_projects(rows: DataFrame) -> DataFrame:
    """Add the projects of a response and whether the list is valid."""
    listed = F.try_variant_get("_value", "$.projects", "array<variant>")
    missing = member(F.col("_value"), "projects").isNull()
    held = rows.withColumn(
        "_listed", F.when(missing, F.array().cast("array<variant>")).otherwise(listed)
    )
    return held.withColumn(
        "_valid", F.coalesce(F.forall("_listed", valid_project), F.lit(False))
    )


def _warning(stage: str) -> Column:
    return (
        F.when(F.col("failure").isNotNull(), F.lit(f"{stage}:LLMError"))
        .when(~F.col("_valid"), F.lit(f"{stage}:ValidationError"))
    )


def judgements(responses: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(doc_id, judged_projects, warning, failure)`` from ``(doc_id, response)``.

    ``judged_projects`` is NULL for a rejected response and empty where nothing was judged.
    """
    rows = _with_projects(parsed(responses))
    warned = rows.withColumn("warning", _warning("llm_scoring_failed"))
    return warned.select(
        "doc_id",
        F.when(
            F.col("warning").isNull(),
            F.transform("_listed", lambda p: normal_project(p, limits)),
        ).alias("judged_projects"),
        "warning",
        "failure",
    )


def rough_project(name: Column, description: Column, technologies: Column, domain: Column) -> Column:
    """A project found in the text, in the shape of a judged one."""
    return F.struct(
        name.alias("name"), description.alias("description"),
        technologies.alias("technologies"), domain.alias("domain"),
        F.lit(None).cast("double").alias("quality_score"),
        F.lit(None).cast("string").alias("quality_rationale"),
        F.lit(None).cast("string").alias("cited_evidence"),
        F.lit(None).cast(SIGNAL_TYPE).alias("signals"),
        F.lit(False).alias("is_thin_wrapper"),
        F.lit(False).alias("is_tutorial"),
    ).cast(PROJECT_TYPE)


def refined_projects(rough: Column, judged: Column) -> Column:
    """Judged projects replace the rough ones when there are any."""
    return F.when(F.size(F.coalesce(judged, F.array().cast(f"array<{PROJECT_TYPE}>"))) > 0, judged).otherwise(rough)


def extractions(responses: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Parse full extraction responses: name, skills, projects and experience highlights."""
    rows = _with_projects(parsed(responses))
    lists = {
        name: absent_or(F.col("_value"), name, is_kind(F.col("_value"), name, "ARRAY<STRING>", "ARRAY<VOID>"))
        for name in ("skills", "experience_highlights")
    }
    named = absent_or(F.col("_value"), "candidate_name", is_kind(F.col("_value"), "candidate_name", "STRING"))
    checked = rows.withColumn(
        "_valid", F.col("_valid") & named & lists["skills"] & lists["experience_highlights"]
    ).withColumn("warning", _warning("llm_extraction_failed"))
    used = F.col("warning").isNull()
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(F.try_variant_get("_value", f"$.{name}", "array<string>"), none)

    return checked.select(
        "doc_id",
        F.when(used, strip(F.coalesce(text_of(F.col("_value"), "candidate_name"), F.lit("")))).alias("given_name"),
        F.when(used, trimmed_names(listed("skills"))).alias("given_skills"),
        F.when(used, F.transform("_listed", lambda p: normal_project(p, limits))).alias("given_projects"),
        F.when(used, listed("experience_highlights")).alias("given_experience"),
        "warning",
    )


def merged(profiles: DataFrame, given: DataFrame) -> DataFrame:
    """Profiles refined by full extractions.

    ``profiles`` needs ``candidate_name``, ``skills``, ``projects`` and ``experience``;
    contact fields found in the text are never replaced. Where ``has_text`` is there and
    false, nothing is refined and the warning says why. Of several extractions of a document
    one counts (:func:`one_per_key`).
    """
    joined = profiles.join(one_per_key(given, "doc_id"), "doc_id", "left")
    has_text = F.coalesce("has_text", F.lit(False)) if "has_text" in profiles.columns else F.lit(True)
    used = F.col("given_skills").isNotNull() & has_text
    name = F.col("given_name")
    good_name = (
        (F.length(name) > 0) & (word_count(name) <= NAME_WORDS) & ~name.rlike(r"\p{Nd}")
    )
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "candidate_name": F.when(used & good_name, name).otherwise(F.col("candidate_name")),
        "skills": F.when(used, F.array_distinct(F.concat("skills", "given_skills"))).otherwise(F.col("skills")),
        "projects": F.when(used, refined_projects(F.col("projects"), F.col("given_projects"))).otherwise(F.col("projects")),
        "experience": F.when(used & (F.size(F.coalesce("given_experience", none)) > 0), F.col("given_experience"))
        .otherwise(F.col("experience")),
        "extraction_method": F.when(used, "hybrid").otherwise("deterministic"),
        "warnings": F.array_compact(F.array(F.when(has_text, F.col("warning")).otherwise("no_text_to_extract"))),
    }).drop("given_name", "given_skills", "given_projects", "given_experience", "warning")
