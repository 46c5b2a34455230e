"""Connected components, and joins that deal hot keys out, against plain versions."""

import random

from evisift.llm.common import salted_join, with_partners
from evisift.llm.components import components


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_hubs_chains_and_random_links(spark):
    draw = random.Random(5)
    hub = [(1000, 2000 + k) for k in range(300)]
    chain = [(k + 1, k) for k in range(3000, 3060)]
    loose = [(draw.randrange(4000, 4100), draw.randrange(4000, 4100)) for _ in range(60)]
    for edges in (hub + chain + loose + [(7, 7), (8, 9), (9, 8), (8, 9), (-5, 8)], [(7, 7)], []):
        table = spark.createDataFrame(edges, "a long, b long")
        assert {r.node: r.label for r in components(table.repartition(3)).collect()} == brute(edges)


def test_salted_join_has_every_pair_once(spark):
    rows = spark.createDataFrame([(i, 0 if i < 500 else i % 40) for i in range(1000)], "doc int, key int").repartition(4)
    partners = spark.createDataFrame([(k, f"body {k}") for k in range(30)], "key int, body string")
    got = sorted((r.doc, r.key, r.body) for r in salted_join(rows, partners, "key", "doc", share=20).collect())
    assert got == sorted((i, k, f"body {k}") for i in range(1000) for k in [0 if i < 500 else i % 40] if k < 30)


def test_partners_with_a_null_key_and_none(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 6)], "i int, k int")
    partners = spark.createDataFrame([(5, 2, "x")], "k int, n long, name string")
    for share in (1, 10):
        assert {r.i: r.name for r in with_partners(rows, partners, ["k"], "n", share).collect()} == {1: None, 2: "x", 3: "x", 4: None}
