"""The whole screening run, cut by written tables where work would be repeated.

1. Later copies are found on narrow rows and leave the texts by an anti join.
2. ``features`` reads the other texts once and is written in buckets of ``doc_id``: everything after works on a
   table a small fraction of the text's size.
3. The gate, activity, judgements and scores follow as joins and projections. Only narrow rows are
   dealt by content, handle or document; the wide row stays in its bucket. Copies join as rows without features.
   The result is written, so the sampling pass of the range sort reads scores
   instead of computing them a second time; the run's counters are taken from the rows as they are written.
4. Ranking writes the ordered results: the one exchange of whole rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evisift.functions.points import as_points
from evisift.operators import activity as act
from evisift.operators.dedupe import DUPLICATE, duplicate_of, later_copies
from evisift.operators.gate import OK, rejection_reasons, unprocessed_reason
from evisift.operators.joins import balanced_left_join, hot_keys
from evisift.operators.judgements import PROJECT_TYPE, judgements, refined_projects
from evisift.operators.landed_keys import of_keys, one_per_key
from evisift.operators.projects import MODEL_TERMS, SIGNALS, project_summary, with_graded_projects
from evisift.operators.ranking import first_in_path_order, ranked
from evisift.operators.scoring import concerns, points, strengths, with_breakdown
from evisift.params import ScreenParams
from evisift.plans.features import features
from evisift.session import written, written_by_key
from evisift.vocabulary import Vocabulary

ACTIVITY_FIELDS = (
    "status string, activity_summary string, activity_hundredths bigint, repo_hundredths bigint, "
    "public_repos int, days_since_last_activity int, recent_events bigint, "
    "relevant_repos array<string>, activity_error string, flagged boolean"
)


SUMMARY = (
    "total_resumes bigint, parsed_ok bigint, parse_failed bigint, duplicates_skipped bigint, eligible bigint, rejected bigint, "
    "llm_used boolean, github_enriched bigint, github_failures bigint, llm_scored bigint, "
    "github_tagged_rate_limited bigint, github_tagged_error bigint, github_no_profile bigint, llm_skipped_by_gate bigint"
)


@dataclass(frozen=True)
class ActivityTables:
    """Landed snapshots; see :mod:`evisift.sources.landed`."""

    profiles: DataFrame
    events: DataFrame
    repos: DataFrame


@dataclass(frozen=True)
class Report:
    results: DataFrame  # one row per document, ordered by ``position``
    summary: DataFrame  # one row of counters


def with_gate(rows: DataFrame) -> DataFrame:
    """Add ``eligible`` and ``rejection_reasons``; documents that were not parsed keep their status."""
    ok = F.col("parse_status") == OK
    reasons = rejection_reasons(F.col("has_text"), F.col("has_python"), F.col("has_ai"))
    return rows.withColumns({
        "eligible": ok & F.col("has_text") & F.col("has_python") & F.col("has_ai"),
        "rejection_reasons": F.when(ok, reasons).otherwise(
            F.array(unprocessed_reason(F.col("parse_status"), F.col("error")))
        ),
        "candidate_name": F.when(ok, F.col("candidate_name")).otherwise(F.col("filename")),
        "skills": F.when(ok, F.col("skills")).otherwise(F.array().cast("array<string>")),
    })


def with_activity(
    rows: DataFrame, found: DataFrame, tables: ActivityTables | None, vocab: Vocabulary, params: ScreenParams
) -> DataFrame:
    """Add the ``activity`` struct. Only eligible rows look their handle up.

    Landed rows of other handles are left out before anything is aggregated; of several
    snapshots of a handle the latest counts (:func:`one_per_key`).
    ``found`` is the features table: handles are counted there, not after the joins.
    """
    looked_up = F.when(F.col("eligible") & act.is_handle(F.col("username")), F.col("username"))
    rows = rows.withColumn("_lookup", looked_up)
    if tables is None:
        types = [f.strip().split(" ", 1) for f in ACTIVITY_FIELDS.split(", ")]
        joined = rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in types])
        missing = "disabled"
    else:
        handles = rows.filter("_lookup IS NOT NULL").select(F.col("_lookup").alias("username")).distinct()
        profiles, events, repos = (of_keys(t, handles, "username") for t in (tables.profiles, tables.events, tables.repos))
        landed = act.activity(one_per_key(profiles, "username"), events, repos, vocab, params)
        landed = landed.withColumnsRenamed({"username": "_lookup", "error": "activity_error"})
        hot = hot_keys(found.select(F.col("username").alias("_lookup")), "_lookup", params.hot_rows)
        # handles meet their activity on narrow rows, which then go to their documents
        looked = rows.filter("_lookup IS NOT NULL").select("doc_id", "_lookup")
        met = balanced_left_join(looked, landed, "_lookup", "doc_id", hot).drop("_lookup")
        joined = rows.join(met, "doc_id", "left")
        missing = "error"
    status = (
        F.when(~F.col("eligible"), "disabled")
        .when(F.col("_lookup").isNull(), "no_profile")
        .otherwise(F.coalesce("status", F.lit(missing)))
    )
    zero = F.lit(0).cast("long")
    table = joined.withColumn("_status", status)
    known = F.col("status").isNotNull()
    ok = F.col("parse_status") == OK
    summary = (
        F.when(~ok, "")
        .when(~F.col("eligible"), act.NOT_ENRICHED_SUMMARY)
        .when(known, F.col("activity_summary"))
        .otherwise(act.status_summary(F.col("_status")))
    )
    activity = F.struct(
        F.col("_status").alias("status"),
        F.when(ok & ~F.col("eligible"), F.col("username")).otherwise(F.col("_lookup")).alias("username"),
        summary.alias("summary"),
        F.coalesce("activity_hundredths", zero).alias("activity_hundredths"),
        F.coalesce("repo_hundredths", zero).alias("repo_hundredths"),
        "public_repos", "days_since_last_activity",
        F.coalesce("relevant_repos", F.array().cast("array<string>")).alias("relevant_repos"),
        F.coalesce("activity_error", F.when(~known & (F.col("_status") == "error"), "no snapshot")).alias("error"),
        F.col("_status").isin(act.FLAGGED).alias("flagged"),
    )
    kept = [c for c in rows.columns if c != "_lookup"]
    return table.select(*kept, activity.alias("activity"))


def with_judgements(
    rows: DataFrame, responses: DataFrame | None, params: ScreenParams, gated: DataFrame | None = None
) -> DataFrame:
    """Add ``refined`` projects, ``replaced``, ``judged`` and ``warnings``.

    Only eligible rows are refined, and only their responses are parsed, one for each document
    (:func:`one_per_key`); ``replaced`` marks rows whose projects came from a judge. ``gated`` may give the eligible
    rows before other joins.
    """
    if responses is None:
        return rows.withColumns({
            "refined": F.col("projects"),
            "replaced": F.lit(False),
            "judged": F.lit(False),
            "warnings": F.array().cast("array<string>"),
        })
    eligible = (rows if gated is None else gated).filter("eligible").select("doc_id").distinct()
    given = judgements(one_per_key(of_keys(responses, eligible, "doc_id"), "doc_id"), params.limits).drop("failure")
    joined = rows.join(given, "doc_id", "left")
    used = F.when(F.col("eligible"), F.col("judged_projects"))
    return joined.withColumns({
        "refined": refined_projects(F.col("projects"), used),
        "replaced": F.coalesce(F.size(used) > 0, F.lit(False)),
        "judged": F.coalesce(F.col("eligible") & F.col("judged_projects").isNotNull(), F.lit(False)),
        "warnings": F.array_compact(F.array(F.when(F.col("eligible"), F.col("warning")))),
    }).drop("judged_projects", "warning")


def with_scores(rows: DataFrame, vocab: Vocabulary, params: ScreenParams, refined: bool) -> DataFrame:
    """Add the ``baseline`` breakdown (rough projects) and the ``final`` one (refined projects).

    Projects are graded for eligible rows only, and a second time only where they were replaced.
    """
    none = F.array().cast(f"array<{PROJECT_TYPE}>")

    def graded(table: DataFrame, wanted: Column, source: str, into: str) -> DataFrame:
        chosen = table.withColumn("_chosen", F.when(wanted, F.col(source)).otherwise(none))
        return with_graded_projects(
            chosen, vocab, params.penalties, "_chosen", into, params.signals, params.tutorial_markers
        ).drop("_chosen")

    rough = graded(rows, F.col("eligible"), "projects", "_rough")
    scored = with_breakdown(rough, params, "_rough", "baseline")
    if not refined:
        return scored.withColumn("final", F.col("baseline")).drop("_rough")
    judged = graded(scored, F.col("eligible") & F.col("replaced"), "refined", "_judged")
    both = judged.withColumn(
        "_refined", F.when(F.col("replaced"), F.col("_judged")).otherwise(F.col("_rough"))
    )
    return with_breakdown(both, params, "_refined", "final").drop("_rough", "_judged", "_refined")


def _if_eligible(value: Column) -> Column:
    return F.when(F.col("eligible"), value)


def with_result_columns(rows: DataFrame, params: ScreenParams) -> DataFrame:
    """The result row of every document, without its rank."""
    none = F.array().cast("array<string>")
    b, a = F.col("final"), F.col("activity")
    enrichment = F.struct(
        a["status"].alias("status"), a["username"].alias("username"), a["summary"].alias("summary"),
        as_points(a["activity_hundredths"]).alias("recent_activity_score"),
        as_points(a["repo_hundredths"]).alias("repos_score"),
        a["public_repos"].alias("public_repos"),
        a["days_since_last_activity"].alias("days_since_last_activity"),
        a["relevant_repos"].alias("relevant_repos"), a["error"].alias("error"),
        a["flagged"].alias("flagged"),
    )
    ok = F.col("parse_status") == OK
    return rows.select(
        "doc_id", "candidate_name", "eligible",
        _if_eligible(b["total"]).alias("total_hundredths"),
        _if_eligible(as_points(b["total"])).alias("total_score"),
        _if_eligible(points(b)).alias("score_breakdown"),
        _if_eligible(as_points(F.col("baseline")["total"])).alias("deterministic_total_score"),
        _if_eligible(points(F.col("baseline"))).alias("deterministic_breakdown"),
        _if_eligible(as_points(b["ai_project_depth"])).alias("llm_ai_project_depth"),
        F.col("skills").alias("matched_skills"),
        F.when(ok, project_summary(
            F.when(F.col("eligible"), F.col("refined")).otherwise(F.col("projects")), params.limits
        )).otherwise("").alias("project_summary"),
        F.coalesce(_if_eligible(a["summary"]), F.lit("")).alias("github_summary"),
        F.coalesce(_if_eligible(strengths(b, a, params)), none).alias("strengths"),
        F.coalesce(_if_eligible(concerns(b, a, params)), none).alias("concerns"),
        "rejection_reasons", enrichment.alias("github"), "source_file", "parse_status",
        F.col("judged").alias("llm_applied"), "warnings",
    )


def results(
    docs: DataFrame, vocab: Vocabulary | DataFrame, params: ScreenParams = ScreenParams(),
    activity: ActivityTables | None = None, responses: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Result rows before ranking."""
    chosen = first_in_path_order(docs, limit)
    narrow = chosen.select("doc_id", "source_file", "filename", "content_hash")
    later = written(later_copies(narrow, params.hot_rows), "later")
    fresh = chosen.join(later.select("doc_id"), "doc_id", "left_anti")
    found = written_by_key(features(fresh, vocab, params), "features", "doc_id")
    known = named_terms(vocab)
    return processed(found, known, params, activity, responses).unionByName(
        processed(unfeatured(later, found), known, params, None, None)
    )


def named_terms(vocab: Vocabulary | DataFrame) -> Vocabulary:
    """The terms that later steps ask for by name or tier; of a vocabulary table, only these become an object."""
    if isinstance(vocab, Vocabulary):
        return vocab
    names = {t for s in SIGNALS for t in s.terms} | set(MODEL_TERMS)
    core = (F.col("grp") == "ai") & (F.col("tier") == "core")
    return Vocabulary.from_table(vocab.filter(core | F.col("canonical").isin(sorted(names))))


def unfeatured(later: DataFrame, found: DataFrame) -> DataFrame:
    """Copies as rows of the features table, whose text was never looked at."""
    given = {
        "doc_id": F.col("doc_id"), "source_file": F.col("source_file"), "filename": F.col("filename"),
        "content_hash": F.col("content_hash"), "parse_status": F.lit(DUPLICATE), "error": duplicate_of(F.col("first_name")),
        "projects": F.array(), "has_text": F.lit(False), "has_python": F.lit(False), "has_ai": F.lit(False),
    }
    return later.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in found.schema
    ])


def processed(
    found: DataFrame, vocab: Vocabulary, params: ScreenParams, activity: ActivityTables | None, responses: DataFrame | None
) -> DataFrame:
    """Result rows from feature rows."""
    gated = with_gate(found)
    enriched = with_judgements(with_activity(gated, found, activity, vocab, params), responses, params, gated)
    return with_result_columns(
        with_scores(enriched, vocab, params, refined=responses is not None), params
    )


def counters() -> list[Column]:
    """The counters of a run over its result rows."""
    status, state = F.col("parse_status"), F.col("github.status")
    return [
        F.count(F.lit(1)).alias("total_resumes"),
        F.count_if(status == OK).alias("parsed_ok"),
        F.count_if(status.isin("failed", "empty")).alias("parse_failed"),
        F.count_if(status == DUPLICATE).alias("duplicates_skipped"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(~F.col("eligible")).alias("rejected"),
        F.coalesce(F.bool_or("llm_applied"), F.lit(False)).alias("llm_used"),
        F.count_if(state == "ok").alias("github_enriched"),
        F.count_if(state.isin("rate_limited", "error")).alias("github_failures"),
        F.count_if("llm_applied").alias("llm_scored"),
        F.count_if(state == "rate_limited").alias("github_tagged_rate_limited"),
        F.count_if(state == "error").alias("github_tagged_error"),
        F.count_if(state == "no_profile").alias("github_no_profile"),
    ]


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Write result rows, and the one row of their counters, which the writing tasks bring along.

    The counters stand right above the write, so each row counts once, for the task that wrote it.
    """
    seen = Observation(name)
    table = written(rows.observe(seen, *counters()), name)
    found = seen.get
    names = [f.strip() for f in SUMMARY.split(",")]
    row = [found[n.split(" ")[0]] for n in names[:-1]]
    skipped = max(0, found["parsed_ok"] - found["eligible"])
    return table, rows.sparkSession.createDataFrame([(*row, skipped)], SUMMARY)


def screen(
    docs: DataFrame, vocab: Vocabulary | DataFrame | None = None, params: ScreenParams = ScreenParams(),
    activity: ActivityTables | None = None, responses: DataFrame | None = None,
    limit: int | None = None,
) -> Report:
    """Screen, score and rank documents.

    ``docs`` is the table of :func:`evisift.sources.files.documents`, one row per
    ``doc_id``. ``activity`` and ``responses`` (``doc_id, response``) are optional landed
    tables; of several rows with one key, one counts. ``vocab`` may be an object or a table of any size.
    """
    vocab = Vocabulary.standard() if vocab is None else vocab
    scored, summary = counted(results(docs, vocab, params, activity, responses, limit), "scored")
    return Report(ranked(scored), summary)
