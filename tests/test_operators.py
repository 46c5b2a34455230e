import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evisift.operators import activity as act
from evisift.operators import dedupe, judgements, projects
from evisift.operators.joins import balanced_left_join, hot_keys
from evisift.operators.ranking import first_in_path_order, numbered
from evisift.operators.scoring import saturated, total_hundredths
from evisift.params import Penalties, ScreenParams
from evisift.sources import files, landed

AS_OF = datetime(2024, 2, 1)
PARAMS = ScreenParams(as_of=AS_OF)


# ---- activity ---------------------------------------------------------------
@pytest.mark.parametrize("days, events, points", [
    (None, 9, 0), (10, 0, 400), (20, 6, 500), (60, 2, 350), (120, 0, 200), (300, 0, 100), (400, 0, 50), (30, 1, 400), (31, 4, 350),
])
def test_recency_bands(spark, days, events, points):
    row = spark.createDataFrame([(days, events)], "d int, n int")
    assert row.select(act.activity_hundredths(F.col("d"), F.col("n"))).collect()[0][0] == points


def ago(days):
    return AS_OF - timedelta(days=days)


def test_repos(spark, vocab):
    repos = [
        ("u", "helper", "RAG", "Go", None, False, ago(10)), ("u", "site", "web", "Go", [], False, ago(10)),
        ("u", "old", "x", "Python", [], False, ago(900)), ("u", "undated", "x", "Python", [], False, None),
        ("f", "copy", "x", "Python", [], True, ago(5)),
    ] + [("m", f"r{i:02}", "llm agent", "Python", ["llm"], None, ago(i)) for i in range(20)]
    table = spark.createDataFrame(repos, landed.REPOS.replace("pushed_at string", "pushed_at timestamp"))
    found = {r.username: r for r in act.repo_activity(table, vocab, PARAMS).collect()}
    assert (found["u"].active_repos, found["u"].relevant_count, found["u"].relevant_repos) == (2, 1, ["helper"])
    assert (found["f"].active_repos, found["f"].relevant_repos) == (0, [])
    assert found["m"].relevant_repos == [f"r{i:02}" for i in range(10)] and found["m"].relevant_count == 20


def test_events_fall_back_to_pushes_and_null_times_do_not_count(spark, vocab):
    profiles = spark.createDataFrame([("a", 200, 1, None), ("b", 404, 1, None), ("c", 500, 1, None)], landed.PROFILES)
    events = spark.createDataFrame([("a", None), ("b", ago(1))], "username string, created_at timestamp")
    repos = spark.createDataFrame([("a", "p", None, "Python", None, False, ago(5))], landed.REPOS.replace("pushed_at string", "pushed_at timestamp"))
    found = {r.username: r for r in act.activity(profiles, events, repos, vocab, PARAMS).collect()}
    assert (found["a"].days_since_last_activity, found["a"].recent_events, found["a"].activity_hundredths) == (5, 0, 400)
    assert found["b"].status == "not_found" and found["b"].activity_hundredths == 0
    assert found["c"].status == "error" and found["c"].error == "status 500" and found["c"].flagged


def test_same_day_events_can_be_left_out(spark):
    from dataclasses import replace

    events = spark.createDataFrame([("a", AS_OF), ("a", ago(3))], "username string, created_at timestamp")
    strict = replace(PARAMS, thresholds=replace(PARAMS.thresholds, same_day_events=False))
    assert act.event_activity(events, PARAMS).collect()[0].recent_events == 2
    assert act.event_activity(events, strict).collect()[0].recent_events == 1


def test_landed_json_with_bad_times(spark, tmp_path):
    rows = [{"username": "a", "created_at": "2024-01-02T03:04:05Z"}, {"username": "a", "created_at": "soon"}, {"username": "a"}]
    (tmp_path / "events.json").write_text("\n".join(map(json.dumps, rows)))
    times = [r.created_at for r in landed.read_events(spark, str(tmp_path)).collect()]
    assert times.count(None) == 2 and datetime(2024, 1, 2, 3, 4, 5) in times


def test_landed_tables_round_trip(spark, tmp_path):
    at = datetime(2024, 1, 5, 6, 7, 8)
    for name, rows, read in (
        ("profiles", [{"username": "a", "http_status": 200, "public_repos": 3}], landed.read_profiles),
        ("repos", [{"username": "a", "name": "r", "topics": ["x"], "fork": False, "pushed_at": "2024-01-05T07:07:08+01:00"}], landed.read_repos),
        ("responses", [{"doc_id": "d", "response": "{}"}], landed.read_responses),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(map(json.dumps, rows)))
        row = read(spark, str(tmp_path / name)).collect()[0].asDict()
        given = {**rows[0], "pushed_at": at} if name == "repos" else rows[0]
        assert {k: row[k] for k in given} == given


# ---- judgements ---------------------------------------------------------------
GOOD = {"name": " A ", "description": "d", "technologies": [" b", "a", "a", ""], "domain": "data", "quality_score": 10}


@pytest.mark.parametrize("response, warning, count", [
    (json.dumps({"projects": [GOOD]}), None, 1),
    ("```json\n" + json.dumps({"projects": [GOOD, GOOD]}) + "\n```", None, 2),
    ("{}", None, 0),
    ("", "llm_scoring_failed:LLMError", None),
    ("nope", "llm_scoring_failed:LLMError", None),
    ("[1]", "llm_scoring_failed:LLMError", None),
    ('{"projects": null}', "llm_scoring_failed:ValidationError", None),
    ('{"projects": "x"}', "llm_scoring_failed:ValidationError", None),
    *[(json.dumps({"projects": [GOOD, {**GOOD, **bad}]}), "llm_scoring_failed:ValidationError", None) for bad in (
        {"name": None}, {"description": 3}, {"quality_score": 10.01}, {"quality_score": -1}, {"quality_score": None},
        {"domain": "x"}, {"technologies": "a"}, {"technologies": [None]}, {"signals": []}, {"is_tutorial": "maybe"},
        {"signals": {"retrieval": None}},
    )],
])
def test_responses(spark, response, warning, count):
    rows = spark.createDataFrame([(1, response)], "doc_id int, response string")
    row = judgements.judgements(rows).collect()[0]
    assert row.warning == warning and (None if row.judged_projects is None else len(row.judged_projects)) == count
    if count:
        assert row.judged_projects[0].name == "A" and row.judged_projects[0].technologies == ["a", "b"]


# ---- projects and points ---------------------------------------------------------
def test_project_split(spark, vocab):
    text = (
        "Projects\n- bullet first\nTitle One | Flask, 2023\n- did it.\nA sentence that ends.\n\nTitle Two\nlong line that is "
        "certainly not a title because it has far too many words to be one\nOnly Title | tail text\nEducation\nx"
    )
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = sorted(projects.projects(docs, vocab).collect(), key=lambda r: r.project_no)
    assert [r.name for r in rows] == ["- bullet first", "Title One", "Title Two", "Only Title"]
    assert rows[1].description == "- did it.\nA sentence that ends." and rows[1].technologies == ["Flask"]
    assert rows[3].description == "tail text" and rows[1].domain == "other" and rows[2].domain == "unknown"


def test_points_are_exact(spark):
    row = spark.range(1000).select(F.col("id").alias("s"), saturated(F.col("id"), 70, 30).alias("p"), saturated(F.col("id"), 40, 15).alias("c"))
    for r in row.collect():
        assert r.p == min(3000, (2 * r.s * 300 + 70) // 140) and r.c == min(1500, (2 * r.s * 150 + 40) // 80)
    totals = spark.range(1).select(total_hundredths(F.lit(0), F.lit(-50000)), total_hundredths(*[F.lit(10000)] * 5)).collect()[0]
    assert tuple(totals) == (0, 10000)
    deduction = spark.range(1).select(projects.thin_deduction(F.lit(20000).cast("long"), Penalties())).collect()[0][0]
    assert deduction == 130000


# ---- joins, duplicates, ranking -----------------------------------------------------
def test_balanced_join_equals_a_left_join(spark):
    left = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "key string, value int")
    expected = sorted(map(str, left.join(right, "key", "left").select("id", "key", "value").collect()))
    for hot_rows in (5, 300, 10**6):
        assert sorted(map(str, balanced_left_join(left, right, "key", "id", hot_keys(left, "key", hot_rows)).select("id", "key", "value").collect())) == expected


def test_hot_rows_spread_over_partitions(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    scattered = F.when(F.col("key") == "hot", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col("key"))
    sizes = [r["count"] for r in left.repartition(4, scattered).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1300


def test_duplicates_first_path_wins(spark):
    rows = [("d/b/1.txt", "1.txt", "h"), ("d/b.x", "b.x", "h"), ("d/a", "a", "g"), ("d/c", "c", ""), ("d/e", "e", "")]
    table = spark.createDataFrame([(f, n, h, "ok", None) for f, n, h in rows], "source_file string, filename string, content_hash string, parse_status string, error string")
    found = {r.filename: (r.parse_status, r.error) for r in dedupe.mark_duplicates(table, 2).collect()}
    assert found["b.x"] == ("duplicate", "duplicate of 1.txt")  # d/b/1.txt comes before d/b.x by path parts
    assert found["1.txt"] == found["a"] == found["c"] == found["e"] == ("ok", None)


def test_pending(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "username string")
    done = dedupe.storable(
        spark.createDataFrame([("a", 200), ("b", 500)], "username string, status int").withColumn("key", dedupe.payload_key("username")),
        F.col("status") == 200)
    assert {r.username for r in dedupe.pending(wanted, done, "username").collect()} == {"b", "c"}


def test_numbering_with_ties(spark):
    rows = spark.range(500).select("id", (F.col("id") % 2 * 0).alias("score"))  # one score for all rows
    placed = {r.id: r.position for r in numbered(rows, [F.col("score").desc(), F.col("id").desc()]).collect()}
    assert placed == {i: 500 - i for i in range(500)}


def test_path_limit(spark):
    table = spark.createDataFrame([(f"d/{i:03}.txt",) for i in range(50)], "source_file string")
    assert {r.source_file for r in first_in_path_order(table, 7).collect()} == {f"d/{i:03}.txt" for i in range(7)}
    assert first_in_path_order(table, 20_000).count() == 50
    assert first_in_path_order(table, None).count() == 50 and first_in_path_order(table, 0).count() == 50


# ---- files ------------------------------------------------------------------------
@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "a.txt").write_text("Ada\nPython", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.PDF").write_bytes(b"%PDF2")
    (tmp_path / "e.png").write_bytes(b"x")
    (tmp_path / "blank.txt").write_text("  \n\n")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "__MACOSX" / "z.txt").write_text("x")
    return str(tmp_path)


def test_scan_and_status(spark, folder):
    scanned = files.scan_folder(spark, folder)
    assert {r.filename for r in files.skipped(scanned).collect()} == {"e.png"}
    kept = files.kept(scanned)
    path = {r.filename: r.source_file for r in kept.collect()}
    assert set(path) == {"a.txt", "b.md", "c.pdf", "d.PDF", "blank.txt"}
    extractions = spark.createDataFrame([
        (path["c.pdf"], "one", 1, "the data and the model", None), (path["c.pdf"], "two", 2, "thedataandthemodelglued", None),
        (path["d.PDF"], "one", 1, " ", None), (path["d.PDF"], "two", 2, None, "ValueError: bad"),
    ], "source_file string, extractor string, pri int, text string, error string")
    rows = {r.filename: r for r in files.documents(kept, extractions).collect()}
    assert rows["b.md"].text == "café" and rows["a.txt"].parse_status == "ok"
    assert rows["c.pdf"].text == "the data and the model"
    assert (rows["d.PDF"].parse_status, rows["d.PDF"].error) == ("failed", "one: no text; two: ValueError: bad")
    assert (rows["blank.txt"].parse_status, rows["blank.txt"].error) == ("empty", files.EMPTY_ERROR)
    alone = {r.filename: r for r in files.documents(kept).collect()}
    assert alone["c.pdf"].error == "no text supplied for .pdf"
    flat = files.scan_folder(spark, folder, recursive=False)
    assert "b.md" not in {r.filename for r in flat.collect()}


def test_unsupported_extension_fails_and_missing_folder_raises(spark, folder):
    rows = {r.filename: r for r in files.documents(files.scan_folder(spark, folder)).collect()}
    assert (rows["e.png"].parse_status, rows["e.png"].error) == ("failed", "unsupported extension: .png")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_folder(spark, folder + "/nowhere").count()


def test_folder_to_report(spark, folder):
    from evisift.plans.screening import screen

    summary = screen(files.documents(files.kept(files.scan_folder(spark, folder)))).summary.collect()[0]
    assert (summary.total_resumes, summary.parsed_ok, summary.parse_failed) == (5, 2, 3)


def test_full_merge_leaves_blank_texts_alone(spark):
    from evisift.operators.judgements import PROJECT_TYPE, extractions, merged

    profile = f"doc_id int, candidate_name string, skills array<string>, projects array<{PROJECT_TYPE}>, experience array<string>, has_text boolean"
    profiles = spark.createDataFrame([(1, "Ada", ["Python"], [], [], True), (2, "b.pdf", [], [], [], False)], profile)
    given = spark.createDataFrame([(i, '{"candidate_name": "Ada Lovelace", "skills": ["Go"]}') for i in (1, 2, 2)], "doc_id int, response string")
    rows = {r.doc_id: r for r in merged(profiles, extractions(given)).collect()}
    assert (rows[1].candidate_name, rows[1].skills, rows[1].extraction_method, rows[1].warnings) == ("Ada Lovelace", ["Python", "Go"], "hybrid", [])
    assert (rows[2].candidate_name, rows[2].skills, rows[2].extraction_method, rows[2].warnings) == ("b.pdf", [], "deterministic", ["no_text_to_extract"])


def test_several_machines_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from evisift.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_the_last_landing_counts(spark):
    from evisift.operators.landed_keys import one_per_key

    rows = [("a", 200, None, 1), ("a", 404, "gone", 2), ("b", 200, "x", 1), ("b", 200, "x", 1)]
    table = spark.createDataFrame(rows, "username string, http_status int, error string, arrived_at int")
    assert {(r.username, r.http_status) for r in one_per_key(table, "username").collect()} == {("a", 404), ("b", 200)}
    assert one_per_key(table, "username").columns == table.columns
