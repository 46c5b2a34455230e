"""Periodic runs against a brute force over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import periodic_runs, queries


def brute_runs(words, least=12):
    """Every maximal stretch of every period, then the smallest period for each stretch."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((i, j - i, p) for (i, j), p in best.items())


def row_of(doc_id, text, tail):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if tail and n and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def found(docs):
    """Runs of several documents at once, per document."""
    words = np.array([w for doc in docs for w in doc], np.int64)
    counts = np.array([len(doc) for doc in docs])
    start, length, period = (x.tolist() for x in periodic_runs.runs_of(words, counts))
    out, ends = [[] for _ in docs], np.cumsum(counts)
    for s, n, p in zip(start, length, period):
        doc = int(np.searchsorted(ends, s, side="right"))
        out[doc].append((s - int(ends[doc] - counts[doc]), n, p))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=90), min_size=1, max_size=4))
def test_two_words_against_brute_force(docs):
    assert found(docs) == [brute_runs(d) for d in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(1, 70)), min_size=1, max_size=8))
def test_repeated_stretches_against_brute_force(parts):
    words = [stretch[i % len(stretch)] for stretch, n in parts for i in range(n)]
    assert found([words, words[::-1], words]) == [brute_runs(words), brute_runs(words[::-1]), brute_runs(words)]


@pytest.mark.parametrize("words", [
    [0] * 5000,
    [0, 1] * 1500 + [0] + [0, 1] * 1500,
    ([0] * 30 + [1]) * 12 + ([0] * 30 + [2]) * 3,
    [0, 1, 0, 1, 0, 0, 1, 0, 1, 0] * 20 + [1, 0] * 40 + [0, 1] * 40,
])
def test_periodic_blocks(words):
    assert found([words]) == [brute_runs(words)]


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1200:
        a, b = b, b + a
    assert found([b]) == [brute_runs(b)]


def test_wavelet_matrix():
    draw = np.random.default_rng(3)
    values = draw.permutation(77)
    tree = periodic_runs.WaveletMatrix(values)
    left = draw.integers(0, 77, 400)
    right = draw.integers(left, 78)
    bound = draw.integers(0, 140, 400)
    assert tree.below(left, right, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(left, right, bound)]
    some = right > left
    left, right = left[some], right[some]
    number = draw.integers(0, right - left)
    assert tree.smallest(left, right, number).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(left, right, number)]


def test_the_query_over_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_run_detection(spark, folder).collect()
    short = {d.doc_id for d in docs if len((d.text or "").split()) < 1500}  # brute force is quadratic
    assert len(got) == len(docs) and len(short) > 100
    assert sorted(tuple(r) for r in got if r.doc_id in short) == sorted(row_of(d.doc_id, d.text, True) for d in docs if d.doc_id in short)
    assert sum(r.n_runs > 0 for r in got) >= len(got) / 20


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "a " * 40, "x\x0by\x0c" * 9, "É é " * 7, "a\xa0b " * 12, "A a " * 6, "w" * 100_000, "p q r " * 20_000]
    rows = [(i, t, i, "n") for i, t in enumerate(texts)] + [(None, "u v " * 8, 0, None), (3, "a " * 40, 3, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed string")
    got = periodic_runs.digest(periodic_runs.find(docs.repartition(3))).collect()
    small = {r for r in range(9)} | {None}
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got if r.doc_id in small), key=key) == sorted(
        (row_of(i, t, False) for i, t, *_ in rows if i in small), key=key)
    assert [tuple(r)[1:6] for r in got if r.doc_id == 9] == [(1, 0, 60_000, 3, 20_000_000)]
    assert periodic_runs.find(docs.limit(0)).collect() == []


def test_a_rewritten_document_without_id_stays():
    assert periodic_runs.repeating_tail(None, 50) is None
