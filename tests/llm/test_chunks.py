"""Repeated rows over several partitions, tables landed twice, and null ids, in the operators that share chunks."""

import numpy as np
import pyarrow as pa
import pytest

from evisift.llm import bpe, chunks, jaccard_join, lm_scoring, queries, substring_dedup

LONG = " ".join(f"a{k}" for k in range(60))
TEXTS = [LONG, LONG + " more", "one two three four five six", None, ""]
OPERATORS = {
    "op1": lm_scoring.score, "op3": lambda docs: bpe.encode(docs, queries.TOKENIZER, texts=False),
    "op4": jaccard_join.join, "op10": substring_dedup.passages,
}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_table_landed_twice_and_null_ids(spark, name):
    rows = [*enumerate(TEXTS), (None, LONG), (None, "other words"), (None, None)]
    docs = table(spark, rows)
    got = OPERATORS[name](docs.union(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(2 * [str(i) for i, _ in rows])
    each = {i: {str(r) for r in got if r["doc_id"] == i} for i in range(len(TEXTS))}
    assert all(len(x) == 1 for x in each.values())
    if name == "op4":
        assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["0", "0", *4 * ["None"]]
    if name == "op10":
        null = [(r["n_words"], r["n_repeated"], r["class_id"]) for r in got if r["doc_id"] is None]
        assert sorted(null) == [(0, 0, None)] * 2 + [(2, 0, None)] * 2 + [(60, 0, None)] * 2
        assert {r["doc_id"]: r["n_repeated"] for r in got if r["doc_id"] in (0, 1)} == {0: 60, 1: 60}


# --- routes of messages ---


@pytest.mark.parametrize(("buckets", "levels", "fan"), [(1, 1, 1), (2, 1, 2), (64, 1, 64), (65, 2, 9), (4096, 2, 64), (5000, 3, 18)])
def test_levels_grow_with_the_logarithm(monkeypatch, buckets, levels, fan):
    monkeypatch.setattr(chunks, "FAN_OUT", 64)
    route = chunks.Route.over(buckets)
    assert (route.levels, route.fan) == (levels, fan) and route.buckets >= buckets


def counted(monkeypatch, docs, chars):
    """Rows that chunks send at every level, and the answers, with many buckets and a small fan."""
    rows = []
    real = chunks.sent
    monkeypatch.setattr(chunks, "sent", lambda *a: rows.append(real(*a)) or rows[-1])

    def pack(part):
        return {**chunks.ids_of(part), "key": np.array([len(t) for t in part.column("text").to_pylist()], np.uint64)}

    def answer(asked):
        every = np.concatenate([x["0.key"] for x in asked])
        return [{"0.n": np.array([int((every == k).sum()) for k in x["0.key"]], np.int64)} for x in asked]

    def finish(body, reply):
        return pa.RecordBatch.from_pydict({"doc_id": chunks.with_nulls(body), "n": reply("0.n")})

    found = chunks.ask_all(docs, pack, lambda body: [(body["key"], {"key": body["key"]})], answer, finish, "doc_id long, n long", chars)
    return {r.doc_id: r.n for r in found.collect()}, [x.count() for x in rows]


def test_messages_stay_in_proportion_to_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FAN_OUT", 3)
    monkeypatch.setattr(chunks, "CHUNK_CHARS", 400)
    monkeypatch.setattr(chunks, "BUCKET_CHARS", 1500)
    totals = {}
    for size in (120, 480):
        texts = [(i, "x" * (1 + i % 37)) for i in range(size)]
        docs = table(spark, texts)
        chars = sum(len(t) for _, t in texts)
        got, rows = counted(monkeypatch, docs, chars)
        lengths = [len(t) for _, t in texts]
        assert got == {i: lengths.count(len(t)) for i, t in texts}
        totals[size] = rows
    # a first level of a fixed number of messages for each chunk, and levels above that are no larger
    assert len(totals[480]) > 1
    assert 3.6 <= totals[480][0] / totals[120][0] * (chunks.Route.over(120 * 18 // 1500).fan / chunks.Route.over(480 * 18 // 1500).fan) <= 4.4
    assert all(x <= totals[480][0] * 1.5 for x in totals[480])


@pytest.mark.parametrize("name", OPERATORS)
def test_several_levels_give_the_same_result(spark, monkeypatch, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    key = lambda r: str(r["doc_id"])
    want = sorted(OPERATORS[name](docs).collect(), key=key)
    monkeypatch.setattr(chunks, "FAN_OUT", 2)
    monkeypatch.setattr(chunks, "CHUNK_CHARS", 50_000)
    monkeypatch.setattr(chunks, "BUCKET_CHARS", 80_000)
    monkeypatch.setattr(jaccard_join, "BUCKET_SHINGLES", 5_000)
    monkeypatch.setattr(jaccard_join, "PORTION_SHINGLES", 2_000)
    got = sorted(OPERATORS[name](docs).collect(), key=key)
    if name == "op1":
        assert [(r.doc_id, r.n_known, r.n_backoffs) for r in got] == [(r.doc_id, r.n_known, r.n_backoffs) for r in want]
        assert all(abs(a.score - b.score) < 1e-6 * abs(b.score) + 1e-9 for a, b in zip(got, want))
    else:
        assert got == want


def test_messages_may_be_unpacked_one_by_one(spark):
    docs = table(spark, [(i, "x" * (1 + i % 5)) for i in range(20)])

    def pack(part):
        return {**chunks.ids_of(part), "key": np.array([len(t) for t in part.column("text").to_pylist()], np.uint64)}

    def answer(asked):
        if hasattr(asked, "__len__"):
            raise ValueError("all messages were unpacked together")
        return ({"0.n": x["0.key"].astype(np.int64) * 10} for x in asked)

    def finish(body, reply):
        return pa.RecordBatch.from_pydict({"doc_id": chunks.with_nulls(body), "n": reply("0.n")})

    found = chunks.ask_all(
        docs, pack, lambda body: [(body["key"], {"key": body["key"]})], answer, finish, "doc_id long, n long", 20, one_pass=True
    )
    assert {r.doc_id: r.n for r in found.collect()} == {i: 10 * (1 + i % 5) for i in range(20)}
