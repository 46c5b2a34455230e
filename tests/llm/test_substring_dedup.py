"""Near-duplicate passages against sliding every pair of documents along each other."""

import random
import re

import pytest

from evisift.llm import substring_dedup as sd

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())


def brute(rows):
    """Words of each document inside a stretch of 50 that another document has with 40 of 46 shingles in place."""
    tokens = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, t in rows for w in [words(t)]}
    hit = {i: set() for i, _ in rows}
    ids = sorted(tokens)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = tokens[i], tokens[j]
            at = {}
            for q, t in enumerate(b):
                at.setdefault(t, []).append(q)
            shifts = {q - p for p, t in enumerate(a) for q in at.get(t, ())}
            for shift in shifts:
                low, high = max(0, -shift), min(len(a), len(b) - shift)
                same = [a[p] == b[p + shift] for p in range(low, high)]
                for p in range(len(same) - 45):
                    stretch = same[p : p + 46]
                    if sum(stretch) >= 40:
                        first = stretch.index(True)
                        last = 45 - stretch[::-1].index(True)
                        span = range(low + p + first, low + p + last + 5)
                        hit[i].update(span)
                        hit[j].update(s + shift for s in span)
    return hit


def ours(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {
        r["doc_id"]: {k for s in r["repeated"] for k in range(s["start"], s["end"])}
        for r in sd.passages(docs).collect()
    }


def corpus(seed, docs=40):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    passages = [[word() for _ in range(draw.randrange(50, 90))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = [word() for _ in range(draw.randrange(0, 120))]
        if draw.random() < 0.5:
            text += draw.choice(passages)
        text += [word() for _ in range(draw.randrange(0, 60))]
        rows.append((i, " ".join(text)))
    return rows


def test_exact_passages_are_all_found(spark):
    rows = corpus(1)
    expected, got = brute(rows), ours(spark, rows)
    assert got == expected
    assert sum(map(len, got.values())) > 500


def test_edited_passages(spark):
    draw = random.Random(5)
    rows = corpus(2)
    edited = []
    for i, text in rows:
        w = text.split()
        for k in range(9, len(w), 60):
            w[k] = f"edit{i}_{k}"
        edited.append((i, " ".join(w)))
    draw.shuffle(edited)
    expected, got = brute(edited), ours(spark, edited)
    wanted, found = sum(map(len, expected.values())), sum(len(got[i] & expected[i]) for i in expected)
    assert all(got[i] <= expected[i] for i in expected)
    assert found >= 0.95 * wanted > 0


@pytest.mark.parametrize("line_words", [30, 44])
def test_repeats_around_a_line_that_hundreds_share(spark, line_words):
    """Pairs in the middle of the line's group also share the words behind or before it, 50 words in all."""
    draw = random.Random(11)
    line, more = [f"line{k}" for k in range(line_words)], 50 - line_words
    rows, wanted = [], {}
    for i in range(300):
        w = [f"w{draw.randrange(10**6)}" for _ in range(30)] + line + [f"w{draw.randrange(10**6)}" for _ in range(30)]
        pair = i % 130 if 20 <= i % 130 < 80 and i < 260 else None
        if pair is not None and pair % 2:
            w[30 + line_words : 80] = [f"behind{pair}_{k}" for k in range(more)]
            wanted[i] = set(range(30, 80))
        elif pair is not None:
            w[30 - more : 30] = [f"before{pair}_{k}" for k in range(more)]
            wanted[i] = set(range(30 - more, 30 + line_words))
        rows.append((i, " ".join(w)))
    got = ours(spark, rows)
    assert len(wanted) == 120
    assert [i for i in wanted if not wanted[i] <= got[i]] == []


def test_defined_cases(spark):
    long = " ".join(f"a{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, "short text"), (4, long), (5, long.upper()), (6, long[:100]), (4, long), (7, "z " * 4000), (8, "z " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_repeated"], r["n_later"], r["class_id"]) for r in sd.passages(docs).collect()}
    assert got == {
        (1, 0, 0, 0, 1), (2, 0, 0, 0, 2), (3, 2, 0, 0, 3), (4, 60, 60, 0, 4), (5, 60, 60, 60, 4),
        (6, len(long[:100].split()), 0, 0, 6), (7, 4000, 4000, 0, 7), (8, 4000, 4000, 4000, 7),
    }


def test_empty_table(spark):
    assert ours(spark, []) == {}


def test_cut_keeps_each_passage_once(spark):
    long = " ".join(f"A{k}" for k in range(60))
    rows = [(1, f"begin one\n{long} end one", "x", 5), (2, f"two {long}\nstop  two", "y", 6), (3, long, "z", 7), (4, None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, n_chars long").withColumnRenamed("_spans", "kind")
    got = {r["doc_id"]: (r["text"], r["kind"], r["n_chars"]) for r in sd.cut(docs).collect()}
    assert got == {1: (rows[0][1], "x", 5), 2: ("two stop  two", "y", 13), 4: (None, "n", None)}


def test_cut_with_names_of_its_own_columns(spark):
    long = " ".join(f"A{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long, "a", 7, None), (2, "two " + long, "b", 8, 9), (None, long, "c", 1, 1)], "doc_id long, text string, _spans string, _DOC int, __spans int")
    kept = sd.cut(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, long, "a", 7, None), (2, "two ", "b", 8, 9), (None, long, "c", 1, 1)]))


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected, got = brute(rows), ours(spark, rows)
    wanted, found = sum(map(len, expected.values())), sum(len(got[i] & expected[i]) for i in expected)
    assert all(got[i] <= expected[i] for i in expected)
    assert found >= 0.97 * wanted > 0


@pytest.mark.parametrize("function", range(sd.FUNCTIONS))
def test_windows_are_the_cartesian_tree(function):
    import numpy as np

    draw = random.Random(function)
    counts = np.array([70, 3, 120])
    codes = np.array([draw.randrange(60) for _ in range(193)])
    hashes = np.array([draw.randrange(2**63) for _ in range(60)], np.uint64)
    tokens = sd.Tokens({"counts": counts, "codes": codes, "hashes": hashes}, 20)
    values = tokens.hashed(function).tolist()
    expected = []
    for c, v in enumerate(values):
        low, high = tokens.starts[tokens.owner[c]], tokens.ends[tokens.owner[c]] - 1
        l, r = c, c
        while l > low and values[l - 1] > v:
            l -= 1
        while r < high and values[r + 1] >= v:
            r += 1
        if r - l + 1 >= 20:
            expected.append((c, l, r))
    got = [(c, l, r) for c, l, r in zip(*(x.tolist() for x in tokens.windows(function))) if r - l + 1 >= 20]
    assert got == expected


def edited_middles(seed):
    """Documents around one line; some pairs far apart in its group share more, but for a word or two."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**6)}"
    line = [f"line{k}" for k in range(30)]
    texts = [[word() for _ in range(40)] + line + [word() for _ in range(40)] for _ in range(90)]
    for k in range(5, 40):
        behind, edit = [word() for _ in range(40)], draw.randrange(40)
        for doc in (k, k + 41):
            texts[doc][70:110] = [*behind]
        for more in range(k % 3):  # none, one or two words side by side
            texts[k][70 + min(edit + more, 39)] = word()
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize(("block", "crowd"), [(20_000, 400), (7, 400), (20_000, 3), (40, 5)])
def test_edited_repeats_in_the_middle_of_a_group(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(sd, "BLOCK", block, raising=False)
    monkeypatch.setattr(sd, "CROWD", crowd, raising=False)
    rows = edited_middles(block + crowd)
    expected = brute(rows)
    assert sum(bool(x) for x in expected.values()) > 40
    assert ours(spark, rows) == expected
    found = {r["doc_id"]: r for r in sd.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [k for k in range(5, 40) if expected[k]]
    assert [k for k in linked if found[k]["class_id"] != k or found[k + 41]["class_id"] != k] == []
    assert all(found[k]["n_later"] == 0 and found[k + 41]["n_later"] == len(expected[k + 41]) for k in linked)


def test_every_edited_passage_is_found(spark):
    """Edits wherever they still leave 40 of 46 shingles, and passages that a document has twice."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for i in range(0, 120, 3):
        passage = [word() for _ in range(50)]
        for doc in range(3):
            own, at = [*passage], draw.randrange(50)
            if doc:
                own[at : at + 1 + i % 2] = [word() for _ in own[at : at + 1 + i % 2]]
            twice = own if i % 5 == 0 and doc == i % 3 else []
            rows.append((i + doc, " ".join([*(word() for _ in range(i % 7)), *own, *(word() for _ in range(i % 4)), *twice])))
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("crowd", [400, 3])
def test_edits_beside_a_line_that_all_share(spark, monkeypatch, crowd):
    """Only the line's own windows lead from one member to the other: behind it (or before) they share nine words after a differing one."""
    monkeypatch.setattr(sd, "CROWD", crowd, raising=False)
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(10**6)}"
    line = [f"line{k}" for k in range(40)]
    texts = [[word() for _ in range(20)] + line + [word() for _ in range(20)] for _ in range(120)]
    for k in range(10, 50):
        place = slice(61, 70) if k % 2 else slice(10, 19)
        texts[k + 53][place] = texts[k][place]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    expected = brute(rows)
    assert sum(bool(x) for x in expected.values()) == 80
    assert ours(spark, rows) == expected
