"""License scans against a plain loop over rules and words."""

import re

from evisift.llm import license_scan as ls

SMALL = "/root/testdata/sf0.001"


def brute(rows, chosen):
    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        line = " " + " ".join(words) + " "
        found = set()
        for r in chosen:
            for m in re.finditer(rf"(?<= ){r.pattern}(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.add((start, start + m.group().count(" ") + 1, r.priority, r.label, r.base))
        order = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3], d[4]))
        stays = [d for k, d in enumerate(order) if not any(e[1] >= d[1] and e[2] >= d[2] for e in order[:k])]
        base = [d for d in order if d[4]]
        out.append((
            doc, len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted({d[3] for d in base})), ",".join(sorted({d[3] for d in [*stays, *base]})),
            max((ls.CONFIDENCE[d[2]] for d in stays), default=0.0),
        ))
    return sorted(out, key=str)


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC-BY-SA 4.0, CC BY 3.0", None, "", "mit",
    "GNU General Public License v3 or later; gplv2, LGPL 2.1 only. GNU general public license", "mit license " * 300,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this. All rights reserved",
    "the Knnu GNU\x00General!Public?License MIT\nLICENSE É license", "BSD 3-Clause License and 3 clause BSD license",
]


def test_rules_are_many_and_pass_the_gates():
    chosen = ls.rules()
    assert len(chosen) >= 300
    assert sum(r.base for r in chosen) == 4
    for r in chosen:
        sample = re.sub(r"\(\?:[^()]*\)\??", "", r.pattern).replace("[cs]", "s").replace(" ?", "").replace("deriv", "deriv")
        assert re.search(ls.HINTS, sample), r
        assert not r.also or r.also in r.pattern.split(" "), r


def test_equals_a_plain_loop(spark):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ls.scan(docs).collect()), key=str) == brute(rows, ls.rules())


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in ls.scan(docs).collect()), key=str) == brute(rows, ls.rules())


def spellings(pattern):
    """Every text of an expression of literals, ``(?:a|b)`` and ``[cs]``, each perhaps optional."""
    m = re.search(r"(\(\?:([^()]*)\)|\[(\w+)\]|.)\?|\(\?:([^()]*)\)|\[(\w+)\]", pattern)
    if not m:
        return {pattern}
    group, letters = m[2] or m[4], m[3] or m[5]
    choices = group.split("|") if group else list(letters) if letters else [m[1]]
    if m[0].endswith("?"):
        choices = [*choices, ""]
    return {x for c in choices for x in spellings(pattern[: m.start()] + c + pattern[m.end() :])}


def test_every_spelling_of_every_rule(spark):
    chosen = ls.rules()
    texts = set()
    for r in chosen:
        found = sorted(spellings(r.pattern))
        assert all(re.fullmatch(r.pattern, x) for x in found), r
        texts.update([*found[:2], *found[-2:]] if r.priority == ls.VERSIONED else found)
    assert "creative commons attribution noncommercial sharealike" in texts
    rows = list(enumerate([*sorted(texts), "Creative Commons Attribution-ShareAlike", "Attribution-NonCommercial-NoDerivatives 4.0, Creative Commons"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["label"], r["priority"], r["start"], r["end"]) for r in ls.detections(docs).collect()}
    compiled = [(re.compile(rf"(?<= ){r.pattern}(?= )"), r) for r in chosen]
    expected = set()
    for doc, text in rows:
        line = " " + " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "
        for expression, r in compiled:
            for m in expression.finditer(line):
                start = line[: m.start()].count(" ") - 1
                expected.add((doc, r.label, r.priority, start, start + m.group().count(" ") + 1))
    assert got == expected


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string, label string")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = ls.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "under the mit license here"), (None, "apache license"), (None, None), (1, "nothing at all"), (1, "the apache license"),
            (2, "mit license"), (2, "mit license"), (3, ""), (4, "x " * 30_000 + "mit license")]
    wide = spark.createDataFrame([(i, t, 5, "l", 6, 7) for i, t in rows], "doc_id long, text string, row long, label string, start int, n_base long")
    got = ls.scan(wide.repartition(3)).collect()
    assert sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.base_labels)) for r in got) == sorted(map(str, [
        ("None", 5, 1, 2, "mit"), ("None", 2, 1, 0, "apache"), ("None", 0, 0, None, ""), ("1", 3, 0, None, ""), ("1", 3, 1, 1, "apache"),
        ("2", 2, 1, 0, "mit"), ("2", 2, 1, 0, "mit"), ("3", 0, 0, None, ""), ("4", 30_002, 1, 30_000, "mit"),
    ]))
