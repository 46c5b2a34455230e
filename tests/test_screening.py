from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evisift.operators.gate import NO_AI, NO_PYTHON
from evisift.params import ScreenParams, Weights
from evisift.plans import report as reports
from evisift.plans.screening import ActivityTables, screen
from evisift.sources import landed

THIN = "Kim Vale\nSkills: Python, OpenAI API\nProjects\nEcho Bot\nSends every user question to the OpenAI API and prints it."
AGENTIC = (
    "Ana Sol\ngithub.com/anasol\nSkills: Python, FastAPI, PostgreSQL\nProjects\nTriage Helper\n"
    "Multi-agent planner with retrieval over embeddings, tool calling and session memory."
)
WEB = "Ian Roe\nSkills: JavaScript, React\nProjects\nShop\nReact shop."
NO_MODEL = "Amy Low\nSkills: Python, Django\nProjects\nBlog\nREST API in Django."
SKILL_ONLY = "Uma Ray\nSkills: Python, PyTorch"
IN_PROJECT = SKILL_ONLY + "\nProjects\nLeaf Check\nA CNN that sorts leaves."
MIXED = "Sam Dee\nSkills: JavaScript, Java, Python\nExperience\nBuilt a RAG service."
AS_OF = datetime(2024, 2, 1)

JUDGED = (
    '{"projects":[{"name":"Triage Helper","description":"Planner with retrieval.","technologies":["LangGraph"],'
    '"domain":"ai_agentic","signals":{"orchestration":true,"retrieval":true,"tool_use":true},"quality_score":8.0,'
    '"quality_rationale":"Orchestration with retrieval."}]}'
)


def by_file(report):
    return {r.source_file.removeprefix("in/"): r for r in report.results.collect()}


def numbers(row):
    b = row.score_breakdown
    return (b.ai_project_depth, b.python_backend, b.cloud_fullstack, b.github, b.engineering_depth, b.penalties, row.total_score)


def snapshots(spark, profiles=(), events=(), repos=()):
    return ActivityTables(
        spark.createDataFrame(list(profiles), landed.PROFILES),
        spark.createDataFrame(list(events), "username string, created_at timestamp"),
        spark.createDataFrame(list(repos), landed.REPOS.replace("pushed_at string", "pushed_at timestamp")),
    )


def test_weights_must_add_up():
    assert Weights().total() == 100
    with pytest.raises(ValueError):
        Weights(github=11)


def test_batch(spark, docs_of):
    report = screen(docs_of({
        "a.txt": AGENTIC, "b.txt": WEB, "c_copy.txt": AGENTIC, "d.txt": "  \n", "e.txt": THIN, "f.txt": NO_MODEL,
        "g.txt": SKILL_ONLY, "h.txt": IN_PROJECT, "i.txt": MIXED,
    }))
    rows = by_file(report)
    assert numbers(rows["a.txt"]) == (24.6, 9.09, 0.0, 0.0, 0.0, -3.0, 30.69)
    assert numbers(rows["e.txt"]) == (9.15, 3.43, 0.0, 0.0, 0.0, -15.0, 0.0)
    assert rows["b.txt"].rejection_reasons == [NO_PYTHON, NO_AI]
    assert rows["f.txt"].rejection_reasons == [NO_AI] == rows["g.txt"].rejection_reasons
    assert rows["b.txt"].matched_skills == ["JavaScript", "React"]
    assert rows["h.txt"].eligible and rows["i.txt"].eligible
    assert rows["c_copy.txt"].rejection_reasons == ["Resume not processed (duplicate): duplicate of a.txt"]
    assert rows["c_copy.txt"].candidate_name == "c_copy.txt"
    summary = report.summary.collect()[0]
    assert (summary.total_resumes, summary.parsed_ok, summary.duplicates_skipped, summary.parse_failed) == (9, 7, 1, 1)
    assert (summary.eligible, summary.rejected, summary.llm_skipped_by_gate) == (4, 5, 3)
    ranked = sorted((r for r in rows.values() if r.eligible), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == [1, 2, 3, 4]
    assert [r.total_score for r in ranked] == sorted((r.total_score for r in ranked), reverse=True)
    for row in rows.values():
        assert row.eligible == (row.rejection_reasons == []) == (row.rank is not None)
        if row.eligible:
            assert 0 <= row.total_score <= 100 and -15 <= row.score_breakdown.penalties <= 0
            assert all(row.score_breakdown.rationale.values())
    assert rows["e.txt"].score_breakdown.rationale["penalties"] == [
        "Thin LLM/API wrapper, no meaningful workflow: Echo Bot (-12.0)",
        "listed without implementation detail: Echo Bot (-3.0)",
    ]
    assert [r.source_file for r in reports.in_order(report.results).limit(2).collect()] == [r.source_file for r in ranked[:2]]


def test_judged_and_unreadable_profile(spark, docs_of):
    docs = docs_of({"a.txt": AGENTIC, "b.txt": WEB})
    responses = spark.createDataFrame([(0, JUDGED), (1, JUDGED)], "doc_id long, response string")
    report = screen(docs, activity=snapshots(spark, [("anasol", 429, None, None)]), responses=responses)
    rows = by_file(report)
    a, b = rows["a.txt"], rows["b.txt"]
    assert numbers(a) == (26.65, 9.09, 0.0, 5.0, 0.0, -3.0, 37.74)
    assert a.deterministic_total_score == 35.69 and a.llm_applied and a.github.flagged
    assert "tagged" in a.score_breakdown.rationale["github"][0]
    assert a.score_breakdown.rationale["ai_project_depth"][0].endswith("Orchestration with retrieval.")
    # the gate is never revisited: no activity and no judgement for a rejected document
    assert not b.eligible and not b.llm_applied and b.github.status == "disabled" and "hard gate" in b.github.summary
    summary = report.summary.collect()[0]
    assert (summary.llm_scored, summary.github_tagged_rate_limited, summary.llm_skipped_by_gate) == (1, 1, 1)


def test_failed_judgement_keeps_the_baseline(spark, docs_of):
    report = screen(docs_of({"a.txt": AGENTIC}), responses=spark.createDataFrame([(0, "broken")], "doc_id long, response string"))
    row = by_file(report)["a.txt"]
    assert row.total_score == 30.69 and not row.llm_applied and row.warnings == ["llm_scoring_failed:LLMError"]


def test_activity_points_reach_the_score(spark, docs_of):
    at = AS_OF - timedelta(days=10)
    tables = snapshots(
        spark, [("anasol", 200, 3, None)], [("anasol", at)] * 6,
        [("anasol", "helper", "RAG agent", "Go", [], False, at), ("anasol", "fork", "x", "Python", [], True, at)],
    )
    row = by_file(screen(docs_of({"a.txt": AGENTIC}), activity=tables, params=ScreenParams(as_of=AS_OF)))["a.txt"]
    assert row.score_breakdown.github == 7.0 and row.github.relevant_repos == ["helper"]
    assert row.strengths[-1] == "Active, relevant public GitHub"
    assert row.github_summary == "last public activity ~10d ago; 6 event(s) in 90d; relevant repos: helper"


def test_missing_snapshot_is_unknown_not_inactive(spark, docs_of):
    row = by_file(screen(docs_of({"a.txt": AGENTIC}), activity=snapshots(spark)))["a.txt"]
    assert row.github.status == "error" and row.github.flagged and row.score_breakdown.github == 5.0


def test_limit_takes_the_first_paths(spark, docs_of):
    docs = docs_of({"b.txt": WEB, "a.txt": AGENTIC, "c.txt": THIN})
    assert set(by_file(screen(docs, limit=2))) == {"a.txt", "b.txt"}


def test_hot_content_and_hot_handle(spark, docs_of):
    texts = {f"{i:02}.txt": AGENTIC for i in range(20)} | {f"x{i}.txt": AGENTIC + f"\nnote {i}" for i in range(10)} | {"w.txt": WEB}
    tables = snapshots(spark, [("anasol", 404, None, None)])
    plain = by_file(screen(docs_of(texts), activity=tables))
    split = by_file(screen(docs_of(texts), activity=tables, params=ScreenParams(hot_rows=2)))
    assert {k: (v.parse_status, v.total_score, v.github.status) for k, v in plain.items()} == {
        k: (v.parse_status, v.total_score, v.github.status) for k, v in split.items()
    }
    assert sum(v.parse_status == "duplicate" for v in split.values()) == 19
    assert split["x3.txt"].github.status == "not_found"


def test_sinks(spark, docs_of, tmp_path):
    report = screen(docs_of({"a.txt": AGENTIC, "b.txt": WEB}))
    reports.write_json(report, f"{tmp_path}/json")
    reports.write_csv(report, f"{tmp_path}/csv")
    back = spark.read.json(f"{tmp_path}/json/candidates")
    assert back.count() == 2 and "score_breakdown" in back.columns
    flat = spark.read.csv(f"{tmp_path}/csv", header=True, inferSchema=True, escape='"').collect()
    assert len(flat[0]) == 16 and {r.candidate_name for r in flat} == {"Ana Sol", "Ian Roe"}
    assert reports.more_than(report.results, 0).collect()[0].more == 1
    assert reports.comparison(report.results).count() == 7
    assert reports.rejected(report.results).collect()[0].skills == "JavaScript, React"
    top = reports.top_reasons(report.results).collect()[0]
    assert top.reasons[0] == "Triage Helper: depth 7.0/10" and len(top.penalties) == 1


def test_text_is_scanned_once_and_shuffled_never(spark, docs_of, vocab, tmp_path):
    from evisift.plans.features import features

    docs_of({"a.txt": AGENTIC}).write.parquet(f"{tmp_path}/docs")
    plan = features(spark.read.parquet(f"{tmp_path}/docs"), vocab, ScreenParams())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    exchange = plan[plan.index("Exchange hashpartitioning"):].splitlines()[1]
    assert "body" not in exchange.split("Project")[1] and "text#" not in exchange
    assert "Window" not in plan and "NestedLoop" not in plan


def test_weights_aliases_and_vocabulary_are_parameters(spark, docs_of):
    from evisift.params import ScreenParams
    from evisift.plans.features import features
    from evisift.vocabulary import Vocabulary

    vocab = Vocabulary.of({"python": {"Snake": ["snake"]}, "backend": {"Lake": ["lake"]}}, {})
    params = ScreenParams(
        python_backend_tenths={"Snake": 30}, cloud_fullstack_tenths={"Lake": 7}, aliases={"projects": ["things made"]},
    )
    docs = docs_of({"a.txt": "Things made\nsnake at the lake\n"})
    row = features(docs, vocab, params).collect()[0]
    assert (row.python_sum, row.cloud_sum, row.python_terms, row.cloud_terms) == (300, 70, ["Snake (project)"], ["Lake (project)"])
    plain = features(docs, vocab, ScreenParams()).collect()[0]
    assert (plain.python_sum, plain.cloud_sum) == (0, 0)


def test_copies_leave_before_the_text_is_matched(spark, docs_of, tmp_path):
    from plan_shape import exchanges, nodes

    from evisift.operators.dedupe import later_copies
    from evisift.plans.features import unit_hits
    from evisift.vocabulary import Vocabulary

    docs_of({"a.txt": AGENTIC, "b.txt": AGENTIC, "c.txt": WEB}).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    narrow = docs.select("doc_id", "source_file", "filename", "content_hash")
    later = later_copies(narrow)
    assert [(r.filename, r.first_name) for r in later.collect()] == [("b.txt", "a.txt")]
    assert all("text" not in columns for _, columns in exchanges(later))
    fresh = docs.join(later.select("doc_id"), "doc_id", "left_anti")
    plan = [n.nodeName() + n.toString().split("\n")[0] for n in nodes(unit_hits(fresh, Vocabulary.standard(), ScreenParams()))]
    anti = next(i for i, name in enumerate(plan) if "LeftAnti" in name)
    explodes = [i for i, name in enumerate(plan) if name.startswith("Generate")]
    # top down: texts are cut into units and tokens above the anti join only
    assert explodes and all(i < anti for i in explodes)


def test_a_copy_gets_no_features(spark, docs_of, monkeypatch):
    from evisift.plans import screening

    seen = []
    real = screening.features
    monkeypatch.setattr(screening, "features", lambda docs, *a: seen.append(docs) or real(docs, *a))
    rows = by_file(screen(docs_of({"a.txt": AGENTIC, "b.txt": AGENTIC, "c.txt": AGENTIC, "w.txt": WEB})))
    assert {r.filename for r in seen[0].collect()} == {"a.txt", "w.txt"}
    assert [rows[n].parse_status for n in ("b.txt", "c.txt")] == ["duplicate", "duplicate"]
    assert rows["c.txt"].rejection_reasons == ["Resume not processed (duplicate): duplicate of a.txt"]


def test_the_wide_row_stays_in_its_bucket(spark, docs_of):
    from plan_shape import exchanges

    from evisift.plans.screening import results
    from evisift.vocabulary import Vocabulary

    tables = snapshots(spark, [("anasol", 404, None, None)])
    responses = spark.createDataFrame([(0, JUDGED)], "doc_id long, response string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
    try:
        rows = results(docs_of({"a.txt": AGENTIC, "b.txt": AGENTIC, "c.txt": WEB}), Vocabulary.standard(), ScreenParams(), tables, responses)
        crossed = exchanges(rows)
        assert rows.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert crossed and not any("projects" in columns or "python_terms" in columns for _, columns in crossed)


def test_counters_come_with_the_write(spark, docs_of):
    from plan_shape import nodes

    report = screen(docs_of({"a.txt": AGENTIC, "b.txt": AGENTIC, "c.txt": WEB}))
    row = report.summary.collect()[0]
    assert (row.total_resumes, row.parsed_ok, row.duplicates_skipped, row.eligible, row.rejected, row.llm_used) == (3, 2, 1, 1, 2, False)
    assert not [n for n in nodes(report.summary) if "FileScan" in n.toString() or n.nodeName() == "Exchange"]
    empty = screen(docs_of({"a.txt": AGENTIC}).limit(0))
    assert empty.results.collect() == [] and empty.summary.collect()[0].total_resumes == 0
