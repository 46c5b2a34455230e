"""Public activity of the people behind documents, from landed snapshots.

Snapshots are three tables keyed by ``username``: profiles, events and repositories.
Every aggregate combines before the shuffle; names of repositories are limited to the
first ten by a rank filter that Spark applies before the shuffle too.
"""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.functions.points import as_points
from evisift.operators.matching import any_term
from evisift.params import ScreenParams
from evisift.vocabulary import Vocabulary

# Fixed values.
NOT_A_HANDLE = ["", "none", "na", "n/a", "username"]
RELEVANT_NAMES = 10
SUMMARY_NAMES = 3
ACTIVITY_CAP, REPOS_CAP = 500, 500
RECENCY_BANDS = [(30, 400), (90, 300), (180, 200), (365, 100)]
OLDEST_BAND = 50
VOLUME_BANDS = [(5, 100), (2, 50)]
REPO_ACTIVE, REPO_RELEVANT = 80, 120
FLAGGED = ["rate_limited", "error"]
NO_PROFILE_SUMMARY = "No GitHub profile on resume"
NOT_ENRICHED_SUMMARY = "Not enriched (eliminated by hard gate)"
STATUS_SUMMARY = {
    "no_profile": NO_PROFILE_SUMMARY,
    "not_found": "GitHub profile not found",
    "rate_limited": "GitHub API rate limited",
    "error": "GitHub profile unavailable",
    "disabled": "",
}


def is_handle(username: Column) -> Column:
    return username.isNotNull() & ~F.lower(username).isin(NOT_A_HANDLE)


def days_between(then: Column, as_of: Column) -> Column:
    """Whole elapsed days, never negative; NULL for an unknown time."""
    seconds = F.unix_micros(as_of) - F.unix_micros(then)
    days = F.floor(seconds / F.lit(86_400_000_000)).cast("int")
    return F.when(days > 0, days).when(days <= 0, 0)


def moment(params: ScreenParams) -> Column:
    """``as_of`` as a literal; a time without a zone is UTC."""
    as_of = params.as_of
    return F.lit(as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc))


def parse_time(text: Column) -> Column:
    """An ISO time as a timestamp; NULL when it is not one. Times without a zone are UTC."""
    return F.try_to_timestamp(text)


def activity_hundredths(days: Column, recent_events: Column) -> Column:
    """Points for recency and volume, 0 to 5, in hundredths."""
    base = F.when(days.isNull(), 0)
    for limit, points in RECENCY_BANDS:
        base = base.when(days <= limit, points)
    volume = F.when(days.isNull(), 0)
    for least, points in VOLUME_BANDS:
        volume = volume.when(recent_events >= least, points)
    return F.least(F.lit(ACTIVITY_CAP), base.otherwise(OLDEST_BAND) + volume.otherwise(0)).cast("long")


def repo_hundredths(active: Column, relevant: Column) -> Column:
    return F.least(F.lit(REPOS_CAP), active * REPO_ACTIVE + relevant * REPO_RELEVANT).cast("long")


def relevant_repo(vocab: Vocabulary) -> Column:
    """TRUE for a repository that names a core term or is written in Python."""
    told = F.concat_ws(
        " ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")),
        F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "),
    )
    core = vocab.names("ai", "core")
    return any_term(told, vocab, core, ("ai",)) | F.coalesce(F.col("language") == "Python", F.lit(False))


def event_activity(events: DataFrame, params: ScreenParams) -> DataFrame:
    """``(username, newest_event, recent_events)``."""
    days = days_between(F.col("created_at"), moment(params))
    recent = days <= params.thresholds.event_days
    if not params.thresholds.same_day_events:
        recent = recent & (days > 0)
    return events.groupBy("username").agg(
        F.max("created_at").alias("newest_event"), F.count_if(recent).alias("recent_events")
    )


def repo_activity(repos: DataFrame, vocab: Vocabulary, params: ScreenParams) -> DataFrame:
    """``(username, newest_push, active_repos, relevant_count, relevant_repos)``."""
    days = days_between(F.col("pushed_at"), moment(params))
    active = ~F.coalesce("fork", F.lit(False)) & F.coalesce(days <= params.thresholds.repo_days, F.lit(False))
    judged = repos.select(
        "username", "pushed_at", F.coalesce("name", F.lit("unnamed")).alias("repo"),
        active.alias("active"), (active & relevant_repo(vocab)).alias("relevant"),
    )
    counts = judged.groupBy("username").agg(
        F.max("pushed_at").alias("newest_push"),
        F.count_if("active").alias("active_repos"),
        F.count_if("relevant").alias("relevant_count"),
    )
    latest = Window.partitionBy("username").orderBy(F.col("pushed_at").desc(), "repo")
    named = (
        judged.filter("relevant")
        .withColumn("_place", F.row_number().over(latest))
        .filter(F.col("_place") <= RELEVANT_NAMES)
        .groupBy("username")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "repo"))).alias("_named"))
    )
    return counts.join(named, "username", "left").select(
        *counts.columns,
        F.transform(
            F.coalesce("_named", F.array().cast("array<struct<_place:int,repo:string>>")),
            lambda x: x["repo"],
        ).alias("relevant_repos"),
    )


def profile_status(http_status: Column) -> Column:
    return (
        F.when(http_status == 200, "ok")
        .when(http_status == 404, "not_found")
        .when(http_status.isin(403, 429), "rate_limited")
        .otherwise("error")
    )


def activity(
    profiles: DataFrame, events: DataFrame, repos: DataFrame, vocab: Vocabulary, params: ScreenParams
) -> DataFrame:
    """One row per landed profile, with status, scores in hundredths and a summary."""
    th = params.thresholds
    none = F.array().cast("array<string>")
    joined = (
        profiles.select(
            "username", "public_repos", profile_status(F.col("http_status")).alias("status"),
            F.coalesce(
                "error",
                F.when(
                    ~F.col("http_status").isin(200, 403, 404, 429),
                    F.concat(F.lit("status "), F.col("http_status").cast("string")),
                ),
            ).alias("error"),
        )
        .join(event_activity(events, params), "username", "left")
        .join(repo_activity(repos, vocab, params), "username", "left")
    )
    ok = F.col("status") == "ok"
    newest = F.coalesce("newest_event", "newest_push")
    counted = joined.withColumns({
        "days_since_last_activity": F.when(ok, days_between(newest, moment(params))),
        "recent_events": F.when(ok, F.coalesce("recent_events", F.lit(0))).otherwise(0),
        "relevant_repos": F.when(ok, F.coalesce("relevant_repos", none)).otherwise(none),
    })
    days, recent, named = (
        F.col("days_since_last_activity"), F.col("recent_events"), F.col("relevant_repos")
    )
    told = F.concat_ws(
        "; ",
        F.when(days.isNull(), F.lit("no recent public activity")).otherwise(
            F.concat(F.lit("last public activity ~"), days.cast("string"), F.lit("d ago"))
        ),
        F.when(recent > 0, F.concat(recent.cast("string"), F.lit(f" event(s) in {th.event_days}d"))),
        F.when(
            F.size(named) > 0,
            F.concat(F.lit("relevant repos: "), F.array_join(F.slice(named, 1, SUMMARY_NAMES), ", ")),
        ),
    )
    return counted.select(
        "username", "status",
        F.when(ok, told).otherwise(status_summary(F.col("status"))).alias("activity_summary"),
        F.when(ok, activity_hundredths(days, recent)).otherwise(F.lit(0).cast("long")).alias("activity_hundredths"),
        F.when(
            ok,
            repo_hundredths(F.coalesce("active_repos", F.lit(0)), F.coalesce("relevant_count", F.lit(0))),
        ).otherwise(F.lit(0).cast("long")).alias("repo_hundredths"),
        F.when(ok, F.col("public_repos")).alias("public_repos"),
        "days_since_last_activity", "recent_events", "relevant_repos",
        F.when(~ok, F.col("error")).alias("error"),
        F.col("status").isin(FLAGGED).alias("flagged"),
    )


def status_summary(status: Column) -> Column:
    told = F.when(F.lit(False), "")
    for name, text in STATUS_SUMMARY.items():
        told = told.when(status == name, text)
    return told.otherwise("")


def activity_points(flagged: Column, username: Column, found: Column, params: ScreenParams) -> Column:
    """Points in hundredths: the scores, or a neutral value for a profile that could not be read."""
    cap = params.weights.github * 100
    value = F.when(
        flagged & username.isNotNull(), F.lit(params.thresholds.unknown_activity_points * 100)
    ).otherwise(F.coalesce(found, F.lit(0)))
    return F.greatest(F.lit(0), F.least(F.lit(cap), value)).cast("long")


def scored_activity(table: DataFrame) -> DataFrame:
    """The activity table with its two scores as points."""
    return table.withColumns({
        "recent_activity_score": as_points(F.col("activity_hundredths")),
        "repos_score": as_points(F.col("repo_hundredths")),
    }).drop("activity_hundredths", "repo_hundredths")
