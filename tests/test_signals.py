"""Signals as data: the automata against one expression per form, and other tables in a whole run."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evisift.operators import signals as sig
from evisift.operators.projects import SIGNALS, project_text, signals, standard_signals
from evisift.params import ScreenParams
from evisift.plans.screening import screen
from test_screening import AGENTIC, THIN, WEB, by_file

ROWS = [
    ("a", "term", "vector"), ("a", "term", "vector search"), ("a", "term", "vector search engine"), ("b", "term", "fine-tuning"),
    ("c", "term", "fine tuning"), ("d", "phrase", "stat"), ("d", "phrase", "state"), ("e", "phrase", "state of"), ("f", "term", "c++"),
    ("f", "term", ".net"), ("g", "term", "x-y z"), ("g", "phrase", "$("), ("h", "phrase", "é"), ("a", "phrase", "vec"), ("i", "term", "RAG"),
    ("i", "term", "r & d"), ("j", "phrase", "a-b"), ("j", "term", "a b"),
]


def brute(text, signal):
    text = text.lower()
    for name, kind, form in ROWS:
        form = form.lower()
        if name == signal and kind == "phrase" and form in text:
            return True
        body = re.escape(form).replace(r"\ ", r"[\s\-_]+")
        if name == signal and kind == "term" and re.search(rf"(?<![a-z0-9]){body}(?![a-z0-9])", text):
            return True
    return False


def test_all_signals_equal_one_expression_per_form(spark):
    rng = random.Random(11)
    pieces = [w for _, _, f in ROWS for w in re.split(r"[ \-]", f) if w] + [f for _, _, f in ROWS] + ["searches", "statue", "xx"]
    glue = [" ", "-", "_", "  ", "", ".", "\n", "é", " & ", "++"]
    texts = ["".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randint(1, 9))) for _ in range(500)] + ["", "RAG"]
    table = sig.SignalTable.of(ROWS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    shown = docs.select("doc", table.found(F.lower("t")).alias("f")).select("doc", *[table.shows(F.col("f"), n).alias(n) for n in table.names()])
    for row in shown.collect():
        for name in table.names():
            assert row[name] == brute(texts[row.doc], name), (name, texts[row.doc])


def test_layers_never_hold_a_form_and_its_beginning():
    forms = ["a", "ab", "abc", "b", "abd", "bc", "c"]
    dealt = sig.layers(forms)
    assert sorted(f for layer in dealt for f in layer) == sorted(forms) and len(dealt) == 3
    assert not any(x != y and y.startswith(x) for layer in dealt for x in layer for y in layer)
    assert sig.tree_pattern(["abc", "abd", "bc"], None) == "(?:ab(?:c|d)|bc)"


def test_tables_are_checked(spark):
    with pytest.raises(ValueError, match="term or a phrase"):
        sig.SignalTable.of([("a", "word", "x")])
    with pytest.raises(ValueError, match="nothing to look for"):
        sig.SignalTable.of([("a", "term", "++")])
    listed = spark.createDataFrame(ROWS, sig.ROWS)
    assert set(sig.SignalTable.from_table(listed.union(listed)).names()) == {r[0] for r in ROWS}
    with pytest.raises(ValueError, match="more than 3"):
        sig.SignalTable.from_table(listed, most=3)
    none = sig.SignalTable.of([])
    assert spark.range(1).select(none.shows(none.found(F.lit("x")), "a")).first()[0] is False


def test_the_fixed_table_has_all_signals(spark, vocab):
    table = standard_signals(vocab)
    assert set(table.names()) == {s.name for s in SIGNALS} | {"mentions_model"}
    project = F.struct(F.lit("Chat").alias("name"), F.lit("LLM with vector search, retrieval and a planner").alias("description"), F.array().cast("array<string>").alias("technologies"))
    shown = spark.range(1).select(signals(project_text(project), table).alias("s")).first().s
    assert {k for k, v in shown.asDict().items() if v} == {"retrieval", "orchestration", "mentions_model"}


def test_other_signals_and_markers_in_a_run(spark, docs_of):
    docs = docs_of({"a.txt": AGENTIC, "e.txt": THIN})
    plain = by_file(screen(docs))
    none = by_file(screen(docs, params=ScreenParams(signals=sig.SignalTable.of([]), tutorial_markers=("bot", "helper"))))
    assert none["a.txt"].score_breakdown.ai_project_depth < plain["a.txt"].score_breakdown.ai_project_depth
    told = none["a.txt"].score_breakdown.rationale["penalties"]
    assert any("tutorial-style" in line for line in told)


def test_a_vocabulary_table_screens_like_the_object(spark, docs_of, vocab):
    docs = docs_of({"a.txt": AGENTIC, "b.txt": WEB, "e.txt": THIN, "c.txt": AGENTIC, "none.txt": ""})
    by_object, by_table = by_file(screen(docs)), by_file(screen(docs, vocab.table(spark)))
    assert {k: str(v) for k, v in by_object.items()} == {k: str(v) for k, v in by_table.items()}


def test_limits_may_be_none(spark, docs_of):
    from evisift.params import Limits

    text = "Skills: Python\nProjects\nLong Tale | 2023\n" + "words of a tale " * 90 + "with retrieval and a planner for LangGraph\n"
    docs = docs_of({"a.txt": text})
    cut = by_file(screen(docs))["a.txt"]
    whole = by_file(screen(docs, params=ScreenParams(limits=Limits(title=None, description=None, summary=None))))["a.txt"]
    assert len(cut.project_summary) < 300 < 1400 < len(whole.project_summary)
    # signals beyond the limit count as soon as nothing is cut
    assert whole.score_breakdown.ai_project_depth > cut.score_breakdown.ai_project_depth
