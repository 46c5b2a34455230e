"""The n-gram Jaccard join against comparing every pair."""

import random
import re

import pytest

from evisift.llm import jaccard_join

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def ours(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard_join.join(docs, **options).collect())


def near_copies(seed, groups, size, vocabulary=400):
    """Groups of texts with more and more edits, so that some pairs are just at the threshold."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(vocabulary)}"
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.randrange(8, 120))]
        for _ in range(draw.randrange(1, size)):
            text = list(base)
            for _ in range(draw.randrange(0, 1 + len(text) // 25)):
                text[draw.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows


def test_defined_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
        (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 3000), (10, "x " * 2999), (7, "a b c d e"),
    ]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2_000, 7])
def test_equals_comparing_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_TEXT", 10 if block > 100 else 0.2)
    rows = near_copies(block, 60, 14)
    assert ours(spark, rows, block=block) == brute(rows)


def test_short_texts(spark):
    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(4, 14)))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"t{k + i % 7}" for k in range(8 + i % 3))) for i in range(40)]
    assert ours(spark, rows) == brute(rows)


def test_prefix_rule_loses_no_linked_text():
    import numpy as np

    draw = random.Random(2)
    for _ in range(3000):
        a = set(draw.sample(range(60), draw.randrange(1, 30)))
        b = {draw.randrange(60) if draw.random() < 0.15 else x for x in a} | set(draw.sample(range(60), draw.randrange(0, 4)))
        if 100 * len(a & b) >= 75 * len(a | b):
            heads = []
            for s in (a, b):
                length, least = (int(x[0]) for x in jaccard_join.prefix_rule(np.array([len(s)]), 75))
                heads.append((set(sorted(s)[:length]), least))
            assert len(heads[0][0] & heads[1][0]) >= max(heads[0][1], heads[1][1])


def test_shared_passage_links_nothing_by_itself(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"q{i}_{k}" for k in range(30))) for i in range(50)]
    rows += [(100 + i, passage + f" tail{i % 3} a b") for i in range(9)]
    assert ours(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard_join.join(docs).collect()) == brute(rows)


def test_region_join_loses_no_link():
    import numpy as np

    draw = random.Random(3)
    sets = []
    for _ in range(40):
        base = [draw.randrange(10**6) for _ in range(60)]
        for _ in range(draw.randrange(1, 6)):
            sets.append(sorted({draw.randrange(10**6) if draw.random() < 0.1 else x for x in base}))
    sizes = np.array([len(s) for s in sets])
    region = jaccard_join.RegionJoin(np.arange(len(sets)), np.arange(len(sets)), np.concatenate([np.array(s) for s in sets]), sizes, 75)
    region.links()
    expected = brute_labels(sets)
    got = {}
    assert [got.setdefault(p, i) for i, p in enumerate(region.parent.tolist())] == expected


def brute_labels(sets):
    label = list(range(len(sets)))
    for i, a in enumerate(map(set, sets)):
        for j in range(i):
            b = set(sets[j])
            if 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other text", "z")], "doc_id long, text string, label string")
    assert sorted(tuple(r) for r in jaccard_join.one_of_each(docs).collect()) == [(1, "a b c d e f", "y"), (2, "other text", "z")]


P, Q = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))


def test_ids_with_several_texts_link_each_for_itself(spark):
    rows = [(1, P), (1, Q), (2, P + " z"), (3, Q + " z"), (9, P), (9, "alone here"), (5, "alone here"), (4, Q), (4, Q), (None, Q), (None, "nobody has this")]
    docs = spark.createDataFrame([(i, t, "a", 1, 2, "c") for i, t in rows],
        "doc_id long, text string, text_hash string, node long, _gone_doc long, _Gone_Text string")
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard_join.join(docs.repartition(4)).collect())
    assert got == sorted(map(str, [
        (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (9, 36, 1), (9, 1, 5), (5, 1, 5), (4, 36, 1), (4, 36, 1), (None, 36, 1), (None, 1, None)]))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, [(1, P), (1, Q), (5, "alone here"), (None, "nobody has this")]))


def test_hot_copies_are_joined_apart(spark):
    from evisift.llm.common import with_partners

    rows = spark.createDataFrame([(i, "a" if i < 50 else f"k{i}" if i < 90 else None) for i in range(100)], "i int, k string")
    partners = spark.createDataFrame([("a", 50, "A")] + [(f"k{i}", 1, f"K{i}") for i in range(50, 80)], "k string, n long, name string")
    got = {r.i: r.name for r in with_partners(rows, partners, ["k"], "n", share=10).collect()}
    assert got == {i: "A" if i < 50 else f"K{i}" if i < 80 else None for i in range(100)}


def test_regions_around_one_component_are_joined(spark):
    # texts 0 to 9 share five seats, two texts without each; of seats 100 and 101 only text 20 is in both, so they stay apart
    rows = [(i, 7 if i < 6 else i, s) for s in range(5) for i in range(10) if i not in (s, s + 5)]
    rows += [(i, 20 if i in (20, 21, 31) else i, 100 + (i > 30)) for i in [20, *range(21, 25), *range(31, 35)]] + [(20, 20, 101)]
    seats = spark.createDataFrame(rows, "doc_id long, label long, seat long")
    regions = spark.createDataFrame([(s, 7, 8) for s in range(5)] + [(100, 20, 5), (101, 20, 5)], "seat long, around long, size long")
    got = sorted(tuple(r) for r in jaccard_join.joined_regions(seats, regions).collect())
    joined = [(i, 7 if i < 6 else i, True, 7, 10) for i in range(10)]
    apart = [(i, label, False, s, 5) for i, label, s in rows if s >= 100]
    assert got == sorted(joined + apart)


def test_region_join_measures_all_shingles_in_portions(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "PORTION_SHINGLES", 10)
    sets = [[-5, 1, 2, 9], [1, 2], [3], [-5, 1, 2, 3, 9], [7, 8]] * 3
    sizes = np.array([len(s) for s in sets])
    region = jaccard_join.RegionJoin(np.arange(15), np.arange(15), np.concatenate([np.array(s) for s in sets]), sizes, 75)
    for pivot in range(15):
        common, whole = region.measure(pivot, np.arange(15))
        assert common.tolist() == [len(set(sets[pivot]) & set(s)) for s in sets]
        assert whole.tolist() == [len(set(sets[pivot]) | set(s)) for s in sets]


def test_a_chunk_makes_its_sets_once(monkeypatch):
    import numpy as np

    made = []
    plain = jaccard_join.distinct_sets
    monkeypatch.setattr(jaccard_join, "distinct_sets", lambda *args: made.append(1) or plain(*args))
    body = {"hashes": np.arange(9, dtype=np.uint64), "codes": np.array([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5, 8]), "counts": np.array([12, 0, 1])}
    first, again = jaccard_join.sets_of(body), jaccard_join.sets_of(body)
    assert made == [1] and all(np.array_equal(a, b) for a, b in zip(first, again))
    assert first[1].tolist() == [6, 0, 1] and first[0][:6].tolist() == sorted(set(first[0][:6].tolist()))
