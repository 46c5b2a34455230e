"""The 100-point score, with a written reason for every category.

All points are whole hundredths until :func:`points`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.points import as_points, clamp, half_up, one_decimal, tenths_text
from evisift.operators.activity import activity_points
from evisift.operators.projects import QUALITY_UNIT, SIGNALS, thin_deduction
from evisift.params import ScreenParams

CATEGORIES = [
    "ai_project_depth", "python_backend", "cloud_fullstack", "github", "engineering_depth",
    "penalties",
]
UNTITLED = "untitled"


def by_name(table: Mapping[str, int], key: Column) -> Column:
    """Look a name up in a small fixed table; NULL when absent."""
    if not table:
        return F.lit(None).cast("int")
    pairs = [F.lit(x) for name, number in table.items() for x in (name, number)]
    return F.element_at(F.create_map(*pairs), key)


def weights_table(spark, params: ScreenParams) -> DataFrame:
    """``(category, term, weight_tenths)``."""
    rows = [("python_backend", t, w) for t, w in params.python_backend_tenths.items()]
    rows += [("cloud_fullstack", t, w) for t, w in params.cloud_fullstack_tenths.items()]
    return spark.createDataFrame(rows, "category string, term string, weight_tenths int")


def source_multiplier(source: Column, params: ScreenParams) -> Column:
    return F.coalesce(by_name(params.thresholds.source_tenths, source), F.lit(5))


def where_label(best: Column, params: ScreenParams) -> Column:
    """Where a term's best mention stands, as shown in the reasons."""
    tenths = params.thresholds.source_tenths
    return (
        F.when(best >= tenths["project"], "project")
        .when(best >= tenths["experience"], "experience")
        .when(best <= tenths["skills"], "skills (list-only)")
        .otherwise("context")
    )


def saturated(total: Column, target_tenths: int, cap: int) -> Column:
    """A weighted sum in hundredths, scaled so that the target earns the cap."""
    return F.least(F.lit(100 * cap), half_up(total * cap * 10, target_tenths)).cast("long")


def best_mentions(evidence_rows: DataFrame, params: ScreenParams) -> DataFrame:
    """``(doc_id, term, best_tenths, python_first, other_first)``: the best place per term.

    The two orders say when a term first appears if python evidence is read before
    the other evidence, and the other way round.
    """
    is_python = F.col("evidence_group") == "python"
    return (
        evidence_rows.filter(F.col("evidence_group") != "ai")
        .groupBy("doc_id", "term")
        .agg(
            F.max(source_multiplier(F.col("source"), params)).alias("best_tenths"),
            F.min(F.struct((~is_python).alias("part"), "line_no", "term_ord")).alias("python_first"),
            F.min(F.struct(is_python.alias("part"), "line_no", "term_ord")).alias("other_first"),
        )
    )


def weighted_scores(evidence_rows: DataFrame, params: ScreenParams) -> DataFrame:
    """``(doc_id, category, weighted_sum, points_hundredths, terms)`` for both weighted categories."""
    th, w = params.thresholds, params.weights
    weights = weights_table(evidence_rows.sparkSession, params)
    hits = best_mentions(evidence_rows, params).join(F.broadcast(weights), "term")
    is_python = F.col("category") == "python_backend"
    totals = hits.groupBy("doc_id", "category").agg(
        F.sum(F.col("weight_tenths") * F.col("best_tenths")).alias("weighted_sum"),
        F.array_sort(F.collect_list(F.struct(
            F.when(is_python, F.col("python_first")).otherwise(F.col("other_first")).alias("at"),
            F.concat("term", F.lit(" ("), where_label(F.col("best_tenths"), params), F.lit(")")).alias("told"),
        ))).alias("_terms"),
    )
    return totals.select(
        "doc_id", "category", "weighted_sum",
        F.when(is_python, saturated(F.col("weighted_sum"), th.python_target_tenths, w.python_backend))
        .otherwise(saturated(F.col("weighted_sum"), th.cloud_target_tenths, w.cloud_fullstack))
        .alias("points_hundredths"),
        F.transform("_terms", lambda t: t["told"]).alias("terms"),
    )


def engineering_hundredths(distinct_terms: Column, params: ScreenParams) -> Column:
    cap = params.weights.engineering_depth
    return F.least(F.lit(cap * 100), distinct_terms * (cap * 25)).cast("long")


def depth_parts(graded: Column, params: ScreenParams) -> Column:
    """Best quality, solid projects and best signal count of graded projects."""
    solid_above = params.thresholds.thin_quality * QUALITY_UNIT
    return F.struct(
        F.array_max(F.transform(graded, lambda p: p["quality"])).alias("best"),
        F.size(F.filter(graded, lambda p: p["quality"] > solid_above)).alias("solid"),
        F.array_max(F.transform(graded, lambda p: p["signal_count"])).alias("best_signals"),
    )


def depth_hundredths(parts: Column, params: ScreenParams) -> Column:
    """Depth points of projects: best quality, breadth and signals over one denominator."""
    th, cap = params.thresholds, params.weights.ai_project_depth
    ten, n, k = 10 * QUALITY_UNIT, th.breadth_projects, len(SIGNALS)
    numerator = (
        parts["best"].cast("long") * (th.depth_percent * cap * n * k)
        + F.least(F.lit(n), parts["solid"]).cast("long") * (th.breadth_percent * cap * ten * k)
        + parts["best_signals"].cast("long") * (th.signal_percent * cap * ten * n)
    )
    return F.least(F.lit(cap * 100), half_up(numerator, ten * n * k)).cast("long")


def depth_reasons(graded: Column, parts: Column, params: ScreenParams) -> Column:
    th, cap = params.thresholds, params.weights.ai_project_depth
    per_project = F.transform(graded, lambda p: F.concat(
        named(p), F.lit(": depth "), one_decimal(half_up(p["quality"], QUALITY_UNIT // 100)), F.lit("/10"),
        F.coalesce(F.concat(F.lit(" — "), p["quality_rationale"]), F.lit("")),
    ))
    solid = F.least(F.lit(th.breadth_projects), parts["solid"])
    total = F.concat(
        F.lit("best-depth "),
        tenths_text(half_up(parts["best"] * (th.depth_percent * cap), 100 * QUALITY_UNIT)),
        F.lit(" + breadth "),
        tenths_text(half_up(solid * (th.breadth_percent * cap), 10 * th.breadth_projects)),
        F.lit(" ("), parts["solid"].cast("string"), F.lit(" solid project(s)) + signals "),
        tenths_text(half_up(parts["best_signals"] * (th.signal_percent * cap), 10 * len(SIGNALS))),
    )
    return F.concat(per_project, F.array(total))


def named(project: Column) -> Column:
    return F.when(F.length(project["name"]) > 0, project["name"]).otherwise(UNTITLED)


def with_depth(rows: DataFrame, params: ScreenParams, graded: str = "graded") -> DataFrame:
    """Add ``depth`` (hundredths), ``depth_reasons`` and ``depth_concerns``.

    Needs the graded AI projects and ``core_terms``, the sorted core terms found in the text.
    """
    th, cap = params.thresholds, params.weights.ai_project_depth
    rows = rows.withColumn("_parts", depth_parts(F.col(graded), params))
    has_projects, terms, parts = F.size(graded) > 0, F.col("core_terms"), F.col("_parts")
    name_only = F.least(
        F.lit(th.name_only_percent * cap), F.size(terms) * (th.name_only_points_per_term * 100)
    ).cast("long")
    return rows.withColumns({
        "depth": F.when(has_projects, depth_hundredths(parts, params)).otherwise(name_only),
        "depth_reasons": F.when(has_projects, depth_reasons(F.col(graded), parts, params))
        .when(F.size(terms) > 0, F.array(F.concat(
            F.lit("AI framework(s) named but no AI project described: "), F.array_join(terms, ", ")
        )))
        .otherwise(F.array(F.lit("No AI/agentic projects found"))),
        "depth_concerns": F.when(
            has_projects,
            F.when(
                parts["best"] < th.thin_quality * QUALITY_UNIT,
                F.array(F.lit("AI project(s) look like thin wrappers (low depth)")),
            ).otherwise(F.array().cast("array<string>")),
        )
        .when(F.size(terms) > 0, F.array(F.lit("No concrete AI project evidence (framework names only)")))
        .otherwise(F.array(F.lit("No AI project evidence"))),
    }).drop("_parts")


def with_penalties(rows: DataFrame, params: ScreenParams, graded: str = "graded") -> DataFrame:
    """Add ``penalty`` (hundredths, zero or less) and ``penalty_reasons``."""
    pen = params.penalties
    tutorial = tenths_text(F.lit(pen.tutorial * 10))
    cap = pen.cap * QUALITY_UNIT

    def deductions(p: Column) -> Column:
        thin = F.when(p["thin"], thin_deduction(p["quality"], pen)).otherwise(F.lit(0).cast("long"))
        listed = F.when(p["tutorial_label"].isNotNull(), pen.tutorial * QUALITY_UNIT).otherwise(0)
        return (thin + listed).cast("long")

    def reasons(p: Column) -> Column:
        thin = F.concat(
            F.lit("Thin LLM/API wrapper, no meaningful workflow: "), named(p), F.lit(" (-"),
            tenths_text(half_up(thin_deduction(p["quality"], pen), QUALITY_UNIT // 10)), F.lit(")"),
        )
        listed = F.concat(p["tutorial_label"], F.lit(": "), named(p), F.lit(" (-"), tutorial, F.lit(")"))
        return F.array_compact(F.array(F.when(p["thin"], thin), listed))

    summed = rows.withColumns({
        "_taken": F.aggregate(
            F.transform(graded, deductions), F.lit(0).cast("long"), lambda acc, x: acc + x
        ),
        "_told": F.flatten(F.transform(graded, reasons)),
    })
    capped = F.when(
        F.col("_taken") > cap,
        F.array(F.concat(F.lit("Penalties capped at -"), tenths_text(F.lit(pen.cap * 10)))),
    ).otherwise(F.array().cast("array<string>"))
    return summed.withColumns({
        "penalty": (-half_up(F.least(F.col("_taken"), F.lit(cap)), QUALITY_UNIT // 100)).cast("long"),
        "penalty_reasons": F.when(
            F.size("_told") == 0, F.array(F.lit("No project-quality penalties"))
        ).otherwise(F.concat("_told", capped)),
    }).drop("_taken", "_told")


def total_hundredths(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return clamp(total, 0, 10_000).cast("long")


def term_reasons(terms: Column, found: str, none: str) -> Column:
    return F.array(
        F.when(F.size(terms) > 0, F.concat(F.lit(f"{found}: "), F.array_join(terms, ", ")))
        .otherwise(none)
    )


def activity_reasons(activity: Column, username: Column, points: Column, params: ScreenParams) -> Column:
    cap = str(params.weights.github)
    unknown = F.concat(
        F.lit("GitHub unavailable ("), activity["status"], F.lit("); tagged — neutral placeholder "),
        one_decimal(points), F.lit(f"/{cap} applied"),
    )
    known = F.concat(F.lit("GitHub enrichment: "), one_decimal(points), F.lit(f"/{cap}"))
    return F.array(F.when(activity["flagged"] & username.isNotNull(), unknown).otherwise(known))


def with_breakdown(rows: DataFrame, params: ScreenParams, projects: str, into: str) -> DataFrame:
    """Add the score breakdown built on graded ``projects`` as a struct of hundredths.

    Rows need the term sums and reasons of ``plans.features`` and an ``activity`` struct.
    """
    keep = rows.columns
    th, w = params.thresholds, params.weights
    scored = with_penalties(with_depth(rows, params, projects), params, projects)
    scored = scored.withColumns({
        "_python": saturated(F.col("python_sum"), th.python_target_tenths, w.python_backend),
        "_cloud": saturated(F.col("cloud_sum"), th.cloud_target_tenths, w.cloud_fullstack),
        "_engineering": engineering_hundredths(F.size("engineering_terms"), params),
        "_github": activity_points(
            F.col("activity.flagged"), F.col("activity.username"),
            F.col("activity.activity_hundredths") + F.col("activity.repo_hundredths"), params,
        ),
    })
    numbers = ["depth", "_python", "_cloud", "_github", "_engineering", "penalty"]
    rationale = F.create_map(
        F.lit("ai_project_depth"), F.col("depth_reasons"),
        F.lit("python_backend"),
        term_reasons(F.col("python_terms"), "Python/backend evidence", "No Python/backend evidence"),
        F.lit("cloud_fullstack"),
        term_reasons(F.col("cloud_terms"), "Cloud/deploy/full-stack evidence", "No cloud/deployment evidence"),
        F.lit("engineering_depth"),
        term_reasons(F.col("engineering_terms"), "Engineering signals", "No engineering-depth signals found"),
        F.lit("github"),
        activity_reasons(F.col("activity"), F.col("activity.username"), F.col("_github"), params),
        F.lit("penalties"), F.col("penalty_reasons"),
    )
    breakdown = F.struct(
        *[F.col(n).alias(c) for n, c in zip(numbers, CATEGORIES)],
        total_hundredths(*[F.col(n) for n in numbers]).alias("total"),
        rationale.alias("rationale"),
    )
    return scored.select(*keep, breakdown.alias(into))


def points(breakdown: Column) -> Column:
    """A breakdown in points, for output."""
    return F.struct(
        *[as_points(breakdown[c]).alias(c) for c in CATEGORIES], breakdown["rationale"].alias("rationale")
    )


def strengths(b: Column, activity: Column, params: ScreenParams) -> Column:
    w = params.weights
    ok = (activity["status"] == "ok") & ~activity["flagged"]
    score = activity["activity_hundredths"] + activity["repo_hundredths"]
    return F.array_compact(F.array(
        F.when(b["ai_project_depth"] >= 60 * w.ai_project_depth, F.lit("Strong AI/agentic project depth")),
        F.when(b["python_backend"] >= 60 * w.python_backend,
               F.lit("Solid Python/backend engineering evidence")),
        F.when(b["cloud_fullstack"] >= 60 * w.cloud_fullstack,
               F.lit("Cloud/deployment and full-stack exposure")),
        F.when(ok & (score >= 500), F.lit("Active, relevant public GitHub")),
    ))


def concerns(b: Column, activity: Column, params: ScreenParams) -> Column:
    w = params.weights
    flagged = activity["flagged"]
    not_enriched = ~flagged & (activity["status"] != "ok") & (F.length(activity["username"]) > 0)
    return F.array_compact(F.array(
        F.when(b["ai_project_depth"] <= 25 * w.ai_project_depth, F.lit("Limited AI project depth")),
        F.when(b["python_backend"] <= 30 * w.python_backend, F.lit("Weak Python/backend evidence")),
        F.when(b["cloud_fullstack"] <= 20 * w.cloud_fullstack, F.lit("Little cloud/deployment evidence")),
        F.when(b["penalties"] < 0, F.lit("Project-quality penalties applied (see score breakdown)")),
        F.when(flagged, F.concat(F.lit("GitHub unavailable ("), activity["status"],
                                 F.lit(") — tagged, neutral placeholder applied")))
        .when(not_enriched, F.concat(F.lit("GitHub not enriched ("), activity["status"], F.lit(")"))),
    ))
