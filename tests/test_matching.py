import random
import re

import pytest
from pyspark.sql import functions as F

from evisift.functions.text import SPACE_CHARS, is_blank, strip
from evisift.operators import matching
from evisift.operators.matching import any_term, evidence, match_rows, skills, terms_in_text
from evisift.params import ScreenParams
from evisift.plans.features import features
from evisift.operators.sections import lines
from evisift.vocabulary import Vocabulary
from plan_shape import count, exchanges


def names(spark, vocab, text, grp=None):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = terms_in_text(docs, vocab).collect()
    return {r.canonical for r in rows if grp is None or r.grp == grp}


def test_vocabulary_sizes(vocab):
    sizes = {g: (len(vocab.names(g)), sum(e.grp == g for e in vocab.entries)) for g in
             ("python", "ai", "backend", "cloud", "engineering")}
    assert sizes == {"python": (18, 24), "ai": (43, 114), "backend": (19, 35), "cloud": (18, 41),
                     "engineering": (9, 56)}
    assert len(vocab.names("ai", "core")) == 31 and len(vocab.names("ai", "general")) == 12


def test_word_boundaries(spark, vocab):
    found = names(spark, vocab, "JavaScript and node.js services", "backend")
    assert {"JavaScript", "Node.js"} <= found and "Java" not in found
    assert "Java" in names(spark, vocab, "wrote Java; then more", "backend")
    assert names(spark, vocab, "PostgreSQL 14", "backend") == {"PostgreSQL"}
    assert "SQL" in names(spark, vocab, "some SQL queries", "backend")


def test_separators_and_punctuation(spark, vocab):
    for text in ("multi agent", "multi-agent", "Multi_Agent", "multi \n agent", "MULTI  -  AGENT"):
        assert "Multi-Agent" in names(spark, vocab, text), text
    assert "Multi-Agent" not in names(spark, vocab, "multiagent")
    assert "Tool Calling" not in names(spark, vocab, "Tools, platforms & more")
    assert "CI/CD" in names(spark, vocab, "(ci/cd)") and "CI/CD" not in names(spark, vocab, "ci / cd")
    assert "C++" in names(spark, vocab, "modern C++, mostly") and "C++" not in names(spark, vocab, "c+ +")
    assert names(spark, vocab, "") == set() and names(spark, vocab, "nothing to see") == set()


def brute_force(vocab, text):
    hits = set()
    for e in vocab.entries:
        body = re.escape(e.surface).replace(r"\ ", r"[\s\-_]+")
        if re.search(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", text, re.IGNORECASE):
            hits.add((e.grp, e.canonical))
    return hits


ODD_FORMS = ["r & d", ".net", "c++ 11", "a--b", "x - y", "_self_", "fine tuning", "fine-tuning", "r&d", "a.b.c.d.e", "(ok)", "e 9"]


@pytest.mark.parametrize("as_table", [False, True])
def test_equals_brute_force_on_random_texts(spark, vocab, as_table):
    rng = random.Random(7)
    if as_table:
        vocab = Vocabulary([*vocab.entries, *Vocabulary.of({"odd": {f.upper(): [f] for f in ODD_FORMS}}).entries])
    surfaces = [e.surface for e in vocab.entries]
    pieces = [w for s in surfaces for w in re.split(r"[ \-/.]", s) if w] + ["x", "9", "the"]
    glue = [" ", "  ", "-", "_", "\n", ".", "/", ", ", "", "é", " - ", "(", ")", "+", "--", "🙂 ", " & ", "\x00"]
    texts = []
    for _ in range(400):
        words = [rng.choice(surfaces if rng.random() < 0.3 else pieces) for _ in range(rng.randint(1, 12))]
        texts.append("".join(w.upper() + rng.choice(glue) if rng.random() < 0.2 else w + rng.choice(glue) for w in words))
    texts.append("rest " * 300 + "api")  # long enough for the distinct path
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {i: set() for i in range(len(texts))}
    for r in terms_in_text(docs, vocab.table(spark) if as_table else vocab).collect():
        found[r.doc_id].add((r.grp, r.canonical))
    for i, text in enumerate(texts):
        assert found[i] == brute_force(vocab, text), repr(text)


def test_any_term_agrees_with_the_join(spark, vocab):
    texts = ["a RAG agent", "storage only", "vector-search", "LoRA", "PEFTs", "semantic   kernel"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    core = vocab.names("ai", "core")
    flagged = {r.doc_id for r in docs.filter(any_term(F.col("text"), vocab, core, ("ai",))).collect()}
    joined = {r.doc_id for r in terms_in_text(docs, vocab).filter("tier = 'core'").collect()}
    assert flagged == joined == {0, 2, 3, 5}


def test_vocabulary_table_and_shuffled_vocabulary(spark):
    small = Vocabulary.of({"g": {"One": ["one", "first one"], "Two": ["two"]}})
    docs = spark.createDataFrame([(1, "one two"), (2, "first-one"), (3, "three")], "doc_id int, text string")
    expected = {(1, "One"), (1, "Two"), (2, "One")}
    by_table = {(r.doc_id, r.canonical) for r in terms_in_text(docs, small.table(spark)).collect()}
    assert match_rows(docs.limit(0), ["doc_id"], "text", small.table(spark)).collect() == []
    assert match_rows(docs, ["doc_id"], "text", small.table(spark).limit(0)).collect() == []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if too large to broadcast
    try:
        by_shuffle = {(r.doc_id, r.canonical) for r in terms_in_text(docs, small).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert by_shuffle == by_table == expected
    assert Vocabulary.from_table(small.table(spark)).entries == small.entries


def test_skills_keep_vocabulary_order(spark, vocab):
    docs = spark.createDataFrame([(1, "docker, langchain\nPYTHON"), (2, "streamlit")], "doc_id int, text string")
    found = {r.doc_id: r.skills for r in skills(docs, vocab).collect()}
    assert found == {1: ["Python", "LangChain", "Docker"], 2: ["Streamlit"]}


def test_whole_text_finds_phrases_across_lines(spark, vocab):
    docs = spark.createDataFrame([(1, "vector\nsearch")], "doc_id int, text string")
    assert skills(docs, vocab).collect()[0].skills == ["Vector Search"]
    assert evidence(lines(docs), vocab).count() == 0


def test_evidence_is_distinct_and_keeps_its_source(spark, vocab):
    text = "Skills: Python, FastAPI\nPython everywhere\nProjects\nBuilt with Python\nBuilt with Python"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = evidence(lines(docs), vocab).filter("term = 'Python'").collect()
    assert sorted((r.source, r.context, r.line_no) for r in rows) == [
        ("project", "Built with Python", 3), ("skills", "Python everywhere", 1), ("skills", "Python, FastAPI", 0),
    ]


def test_one_scan_one_broadcast_no_cross_join(spark, vocab):
    docs = spark.createDataFrame([(1, "python")], "doc_id int, text string")
    plan = match_rows(docs, ["doc_id"], "text", vocab)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_hits_do_not_depend_on_the_length_of_the_text(spark):
    vocab = Vocabulary.of({"g": {"One": ["one"]}})
    docs = spark.createDataFrame([(1, "one " * 5), (2, "one " * 500)], "doc_id int, text string")
    assert sorted(r.doc_id for r in match_rows(docs, ["doc_id"], "text", vocab).collect()) == [1, 2]


def test_groups_beyond_a_hundred_thousand_terms_keep_their_order(spark):
    from evisift.vocabulary import Entry

    rows = [("b", 1, "Late", 0, "late", None), ("a", 0, "Early", 200_000, "early", None)]
    table = spark.createDataFrame(rows, ", ".join(["grp string, grp_ord int, canonical string, ord int, surface string, tier string"]))
    docs = spark.createDataFrame([(1, "late early")], "doc_id int, text string")
    assert skills(docs, table).collect()[0].skills == ["Early", "Late"]
    assert Vocabulary([Entry(*r) for r in rows]).names() == ["Late", "Early"]


def test_no_text_crosses_an_exchange_on_a_term_key(spark, vocab, tmp_path):
    docs = spark.createDataFrame([(1, "python and fastapi")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if too large to broadcast
    try:
        found = match_rows(docs, ["doc_id"], "text", vocab.table(spark))
        assert {r.canonical for r in found.collect()} == {"Python", "FastAPI"}
        found = match_rows(docs, ["doc_id"], "text", vocab.table(spark))
        seen = [what for how, what in exchanges(found) if "_key" in how]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # a gram is as long as a form, and the text is not there
    assert [sorted(set(what) - {"_carry"}) for what in seen] == [["_gram", "_key", "_share", "doc_id"]]


def test_a_frequent_core_is_dealt_over_several_tasks(spark):
    from evisift.operators.phrases import SPREAD, match_grams

    docs = spark.range(200).selectExpr("id AS doc_id", "'the the end' AS text")
    table = Vocabulary.of({"g": {"The": ["the"], "End": ["the end"]}}).table(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = match_grams(docs, ["doc_id"], "text", table, ["canonical", "_share"])
        counts = {(r.canonical, r._share): r["count"] for r in hits.groupBy("canonical", "_share").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # "the the" gives two grams of "the": the characters beside them differ
    assert len(counts) == 2 * SPREAD and sum(counts.values()) == 600 and max(counts.values()) < 600 / 4


def test_a_large_vocabulary_is_repeated_only_where_texts_ask(spark, monkeypatch):
    from evisift.operators import phrases

    rows = [("g", 0, f"T{k}", k, f"word{k} x", None) for k in range(40)] + [("g", 0, "Odd", 40, "fine-tuning", None)]
    table = spark.createDataFrame(rows, "grp string, grp_ord int, canonical string, ord int, surface string, tier string")
    docs = spark.createDataFrame([(k, f"word{k} x, then word1 X; fine-tuning") for k in range(6)], "doc_id int, text string")
    expected = {(k, name) for k in range(6) for name in (f"T{k}", "T1", "Odd")}
    kept = []
    real = phrases.with_text
    monkeypatch.setattr(phrases, "MANY_FORMS", 10)
    monkeypatch.setattr(phrases, "with_text", lambda *a: kept.append(real(*a)) or kept[-1])
    found = {(r.doc_id, r.canonical) for r in terms_in_text(docs, table).collect()}
    assert found == expected
    stored = kept[0].groupBy("canonical").count().collect()
    assert {r.canonical for r in stored} == {"Odd", *(f"T{k}" for k in range(6))}
    # a form that one text asks for stands in one part, not in all
    assert all(r["count"] == 1 for r in stored if r.canonical not in ("Odd", "T1"))


@pytest.mark.parametrize("limit", ["MANY_FORMS", "TREE_WORDS"])
def test_no_n_grams_of_texts_are_broadcast(spark, monkeypatch, tmp_path, limit):
    from evisift.operators import phrases
    from evisift.session import written as real

    rows = [("g", 0, f"T{k}", k, f"word{k} x", None) for k in range(200)]
    table = spark.createDataFrame(rows, "grp string, grp_ord int, canonical string, ord int, surface string, tier string")
    spark.createDataFrame([(k, f"word{k} x, then word1 X") for k in range(6)], "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))  # files far below the size that is broadcast
    frames = []
    monkeypatch.setattr(phrases, limit, 10)
    monkeypatch.setattr(phrases, "written", lambda t, name: frames.append(t) or real(t, name), raising=False)
    found = match_rows(docs, ["doc_id"], "text", table)
    assert sorted({(r.doc_id, r.canonical) for r in found.collect()}) == sorted({(k, n) for k in range(6) for n in (f"T{k}", "T1")})
    assert [count(f, "Broadcast") for f in [*frames, found]] == [0] * (len(frames) + 1)


def test_a_large_vocabulary_finds_what_a_small_one_does(spark, vocab, monkeypatch):
    from evisift.operators import phrases

    rng = random.Random(11)
    odd = [("odd", 9, None if k % 3 == 0 or f is None else f.upper(), k, f, None) for k, f in enumerate([*ODD_FORMS, "( ok", "b\u00e9 2", None, "--"])]
    schema = "grp string, grp_ord int, canonical string, ord int, surface string, tier string"
    table = vocab.table(spark).select("grp", "grp_ord", "canonical", "ord", "surface", "tier").union(spark.createDataFrame(odd, schema))
    pieces = [*(f for f in ODD_FORMS), "python", "c++", "node", "js", "ok", "b\u00e9", "2", "fine", "tuning", "ci/cd"]
    glue = [" ", " ", "  ", "-", "_", "\n", ".", "/", "(", ")", "( ", "(  ", " & ", "\x00", "\u3000", "-" * 40]
    texts = [(k, "".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randint(0, 9)))) for k in range(200)]
    # keys that repeat or are null
    texts += [(None, "python c++ fine-tuning"), (7, "python"), (7, "python"), (8, None), (None, None), (9, ""), (8, "no term"), (8, "ok " * 60)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").withColumn("len", F.length("text")).repartition(4)

    def found(carry):
        rows = match_rows(docs, ["doc_id", "len"], "text", table, carry).collect()
        return sorted(map(str, rows))

    carries = [None, F.col("doc_id").isin(8, 9) | F.col("text").isNull()]
    monkeypatch.setattr(phrases, "TREE_WORDS", 10)
    small = [found(c) for c in carries]
    monkeypatch.setattr(phrases, "MANY_FORMS", 10)
    assert [found(c) for c in carries] == small
    monkeypatch.setattr(phrases, "EXACT_LISTED", 2)
    assert found(None) == small[0]
    assert len(small[0]) > 500 and len(small[1]) > len(small[0])


def test_first_runs_that_begin_alike_are_told_apart(spark):
    small = Vocabulary.of({"g": {"Java": ["java"], "Script": ["javascript"], "Two": ["java script"]}})
    texts = ["java", "javascript", "Java-Script", "javas", "xjava", "9java", "java javascript"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = sorted((r.doc_id, r.canonical) for r in terms_in_text(docs, small.table(spark)).collect())
    assert found == [(0, "Java"), (1, "Script"), (2, "Java"), (2, "Two"), (6, "Java"), (6, "Script")]


def test_only_first_runs_of_forms_are_exploded(spark, vocab, monkeypatch):
    texts = ["Python, zebra and c++ in REST-api; pythonic node.js", "", None, "\u212aafka \U0001f600gcp\u00e9aws", "sql sql,sql"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    told = docs.select("doc_id", F.lower("text").alias("t"))
    runs = {r.doc_id: r.runs for r in told.select("doc_id", matching.first_runs("t", vocab).alias("runs")).collect()}
    assert runs == {0: ["python", "c", "rest", "node", "js"], 1: [], 2: None, 3: ["kafka", "gcp", "aws"], 4: ["sql", "sql", "sql"]}
    found = {tuple(r) for r in match_rows(docs, ["doc_id"], "text", vocab).drop("term_ord").collect()}
    monkeypatch.setattr(matching, "TREE_WORDS", 1)  # a large vocabulary: all runs
    assert {tuple(r) for r in match_rows(docs, ["doc_id"], "text", vocab).drop("term_ord").collect()} == found


def test_blank_is_what_strip_leaves_nothing_of(apply):
    values = ["", " ", "a", f" {SPACE_CHARS}", f"{SPACE_CHARS}x{SPACE_CHARS}", "\u200b", None, *SPACE_CHARS]
    assert apply(is_blank, values) == apply(lambda x: F.length(strip(x)) == 0, values)


def test_no_order_of_the_features_is_a_struct_within_a_struct(docs_of, vocab):
    docs = docs_of({"a.txt": "Ana Bo\nSkills: Docker, Python, Redis, FastAPI, pytest"})
    plan = features(docs, vocab, ScreenParams())._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(collect_list(" in plan and "array_sort(collect_list(" not in plan
