"""Votes, features and expectation-maximisation of the quality classifier, against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest

from evisift.llm import quality_classifier as qc
from evisift.llm.common import spaced_words, word_hashes

TEXTS = [None, "", " \n \n", "a b\na b\nc", "LOUD # idiot! $$\n\nLOUD # idiot! $$", "élan Élan\n\xa0\n東京 idiot", "x" * 9000, "w v " * 4000 + "\n" + "w v " * 4000]


def plain_em(rows, counts, weight, rounds=60):
    n = len(rows[0])
    bad = []
    for row in rows:
        b, g = (sum(w for v, w in zip(row, weight) if v == s) for s in (1, -1))
        bad.append((b + 0.1) / (b + g + 0.2 + n * 0.1))
    for _ in range(rounds):
        log = {}
        for side, right in ((True, 1), (False, -1)):
            mass = [c * (p if side else 1 - p) for c, p in zip(counts, bad)]
            table = {}
            for k in range(n):
                t = {v: 1.0 + sum(m for m, row in zip(mass, rows) if row[k] == v) for v in (-1, 0, 1)}
                t[right] += weight[k] * sum(c for c, row in zip(counts, rows) if row[k] == right)
                total = sum(t.values())
                table[k] = {v: x / total for v, x in t.items()}
            log[side] = [math.log(sum(mass) + 1.0) + sum(math.log(table[k][row[k]]) for k in range(n)) for row in rows]
        new = [1 / (1 + math.exp(max(-50, min(50, g - b)))) for b, g in zip(log[True], log[False])]
        if max(abs(x - y) for x, y in zip(new, bad)) < 1e-6:
            break
        bad = new
    return bad


@pytest.mark.parametrize("labellers", [(), ("symbols", "shouting", "human"), ("insults", "few_distinct", "toxic_human")])
def test_expectation_maximisation_equals_plain_loops(labellers):
    draw = np.random.default_rng(9)
    rows = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    counts = draw.integers(1, 400, len(rows)).astype(float)
    weight = [qc.TRUST_IN.get(name, qc.TRUST) for name in labellers] or [qc.TRUST] * 3
    got = qc.expectation_maximisation(np.array(rows), counts, labellers)
    assert np.abs(got - plain_em(rows, counts.tolist(), weight)).max() < 1e-9


def test_a_labeller_is_trusted_by_name_and_not_by_place():
    rows, counts = np.array([(1, -1), (-1, 1), (0, 1)]), np.array([5.0, 9.0, 2.0])
    first = qc.expectation_maximisation(rows, counts, ("human", "symbols"))
    last = qc.expectation_maximisation(rows[:, ::-1], counts, ("symbols", "human"))
    assert np.abs(first - last).max() < 1e-12


def test_votes_and_slots_equal_plain_loops():
    part = pa.table({"text": pa.array(TEXTS, pa.string())})
    votes, owner, slot, counts = qc.featured(part)
    assert counts.tolist() == [len((t or "").encode().split()) for t in TEXTS]
    texts = [t or "" for t in TEXTS]
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    assert qc.repeated_lines(pa.array(texts)).tolist() == pytest.approx([1 - len(set(x)) / max(len(x), 1) for x in lines])
    n_symbols, n_bytes = qc.bytes_in(pa.array(["ü"] + texts)[1:], qc.SYMBOLS)
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert n_symbols.tolist() == [sum(b in qc.SYMBOLS for b in t.encode()) for t in texts]
    assert votes["insults"].tolist() == [0, 0, 0, 0, 1, 1, 0, 0]
    assert votes["repeated_lines"].tolist() == [1, 1, 1, 1, 1, -1, -1, 1]
    for k, t in enumerate(texts):
        words = {qc.re.sub(r"\W+", "", w) for w in spaced_words(pa.array([t]))[2].to_pylist()}
        forms = sorted(words | {"^" + w[: qc.STEM] for w in words})
        want = set((word_hashes(pa.array(forms, pa.string())) % np.uint64(qc.SLOTS)).tolist()) if forms else set()
        assert set(slot[owner == k].tolist()) == want


def test_a_small_share_of_labels_is_not_rounded_to_none(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert 0 < qc.sample_features(docs, labels, 30).num_rows < 90
    assert qc.sample_features(docs, labels, 3000).num_rows == 3000
