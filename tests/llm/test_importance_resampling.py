"""Importance resampling against zlib's checksums and a plain loop."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import importance_resampling as ir
from evisift.llm import queries
from evisift.llm.common import PLAIN_WORD


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(PLAIN_WORD, lower)


def buckets_of(text, how):
    words = words_of(text)
    grams = [" ".join(words[i : i + n]) for n in range(how.shortest, how.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % how.buckets for g in grams]


def plain(docs, target, how):
    seen = [(i, *buckets_of(t, how)) for i, t in docs]
    raw = collections.Counter(b for _, _, bs in seen for b in bs)
    aim = collections.Counter(b for t in target for b in buckets_of(t, how)[1])
    s_all, t_all, size = sum(raw.values()), sum(aim.values()), how.buckets
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + size) / ((raw[b] + 1) * (t_all + size)))) for b in raw}
    rows = []
    for i, n, bs in seen:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= how.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r: k + 1 for k, r in enumerate(able[: how.percent * len(able) // 100])}
    return sorted([(*r[:4], rank.get(r)) for r in rows], key=str)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.data())
def test_checksums_of_any_stretch(data, draw):
    running = ir.running_crc(np.frombuffer(data, np.uint8))
    a = draw.draw(st.lists(st.integers(0, len(data)), min_size=1, max_size=9))
    b = [draw.draw(st.integers(x, len(data))) for x in a]
    got = ir.crc_between(running, np.array(a), np.array(b))
    assert got.tolist() == [zlib.crc32(data[x:y]) for x, y in zip(a, b)]


def test_checksums_over_many_lanes():
    data = np.random.default_rng(1).integers(0, 256, 300_001).astype(np.uint8)
    running = ir.running_crc(data)
    a, b = np.array([0, 0, 5, 123_456, 299_990]), np.array([300_001, 0, 300_000, 234_567, 300_001])
    assert ir.crc_between(running, a, b).tolist() == [zlib.crc32(data[x:y].tobytes()) for x, y in zip(a, b)]


TEXTS = [
    None, "", " \n", "one", "A a A-a", "x" * 60_000, "word " * 30_000, "ÉCOLE École 東京 ١٢٣ Ⅷ", "a　b c d", "🙂🙂 👩‍👩‍👧!",
    "it's we'll", "a\x00b", " lead and trail ",
]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aB é-", max_size=30)), min_size=1, max_size=6), st.integers(1, 3))
def test_features_of_any_text(texts, longest):
    how = ir.Resampling(longest=longest)
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    counts, buckets, owner = ir.features(pa.array(texts, pa.string()), how)
    want = [buckets_of(t, how) for t in texts]
    assert counts.tolist() == [n for n, _ in want]
    assert [sorted(buckets[owner == k].tolist()) for k in range(len(texts))] == [sorted(b) for _, b in want]


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    want = plain(docs, target, ir.Resampling())
    assert rows_of(queries.op13_importance_resampling(spark, folder)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_odd_rows_longer_runs_and_clashing_columns(spark):
    how = ir.Resampling(shortest=1, longest=3, min_words=1, percent=50)
    rows = [*enumerate(TEXTS), (None, "some words here")]
    wide = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, position int, spread string, n_words int")
    target = spark.createDataFrame([("q", "word a b"), ("r", None)], "item_id string, text string")
    assert rows_of(ir.resample(wide.repartition(3), target, how)) == plain(rows, ["word a b", None], how)


def test_repeated_rows_and_empty_tables(spark):
    how = ir.Resampling(min_words=1, percent=100)
    rows = [(1, "a b c")] * 5 + [(None, "c d")] * 5 + [(2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("c",)], "text string")
    got = rows_of(ir.resample(docs, target, how))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 11))
    assert {len({r[4] for r in got if r[0] == i}) for i in (1, None)} == {5}
    assert [r for r in got if r[0] == 2][0][1::3] == (0, None)
    assert ir.resample(docs.limit(0), target, how).collect() == []
    assert len(ir.resample(docs, target.limit(0), how).collect()) == 11
