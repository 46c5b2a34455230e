"""The URL models against plain counts in dictionaries, the threshold against trying all, and held-out rates."""

import math
import re
from collections import Counter

import pytest

from evisift.llm import chunks, url_filter

FOLDER = "/root/testdata/sf0.001"


def parts(url):
    m = re.search(r"://([^/?#]*)(/[^?#]*)?", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2] or "") if m else ("", "")


def windows(host, path):
    text = f"\x02{host}\x1f{path}\x03"
    for i, char in enumerate(text):
        past = "\x02" * url_filter.ORDER + text[:i]
        yield char, [past[len(past) - k:] for k in range(url_filter.ORDER + 1)]


def plain_ratios(rows):
    """From ``(host, path, decided, held)``: log-likelihood difference per character."""
    models = {v: (Counter(), Counter()) for v in ("allow", "block")}
    for host, path, decided, held in rows:
        if decided and not held:
            together, alone = models[decided]
            for char, histories in windows(host, path):
                together.update((h, char) for h in histories)
                alone.update(histories)
    out = []
    for host, path, _, _ in rows:
        told = {}
        for verdict, (together, alone) in models.items():
            total = n = 0
            for char, histories in windows(host, path):
                p = 1 / 256
                for h in histories:
                    p = (together[h, char] + url_filter.PRIOR * p) / (alone[h] + url_filter.PRIOR)
                total, n = total + math.log(p), n + 1
            told[verdict] = total
        out.append((told["allow"] - told["block"]) / n)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ratios_equal_plain_counts(spark, monkeypatch, small):
    if small:  # many chunks and buckets on two levels
        monkeypatch.setattr(chunks, "FAN_OUT", 3)
        monkeypatch.setattr(chunks, "BUCKET_CHARS", 20_000)
        monkeypatch.setattr(url_filter, "URL_CHARS", 900)
    found = url_filter.scored(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    assert len(found) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    want = plain_ratios([(r.host, r.path, r.decided, r.held) for r in found])
    assert {r.decided for r in found} == {None, "allow", "block"} and any(r.held for r in found)
    assert all(abs(r.ratio - w) < 1e-9 for r, w in zip(found, want))


def test_odd_urls_and_clashing_columns(spark):
    urls = [
        None, "", "no scheme", "http://a.b.NET/x", "https://x.org/fr/2", "http://h?q=/a", "http://a.b.NET/x", "http://é.org/fr/東京🙂", "a://b\x1fc/\x02\x03",
        "http://example.com/de/" + "y" * 300_000, "x://org/fr/" + "z/" * 1000,
    ]
    rows = [*enumerate(urls), (None, "http://a.b.NET/x"), (3, "http://a.b.NET/x")]
    frame = spark.createDataFrame([(i, u, "t", "h", 1) for i, u in rows], "page_id long, url string, text string, host string, held int")
    got = url_filter.judge(frame.repartition(3)).collect()
    assert sorted((str(r.page_id), r.host, r.path) for r in got) == sorted((str(i), *parts(u)) for i, u in rows)
    assert len({(r.verdict, r.ratio) for r in got if r.host == "a.b.net"}) == 1
    assert len({(r.verdict, r.ratio) for r in got if r.host == ""}) == 1
    assert url_filter.judge(frame.limit(0)).collect() == []
    none = url_filter.judge(frame.filter("page_id IN (1, 2, 5)")).collect()
    assert {(r.rule, r.verdict, r.ratio) for r in none} == {(None, "allow", 0.0)}


def test_threshold_is_the_best_of_all(spark):
    rows = [("allow", 0.1 * k) for k in range(-3, 9)] + [("block", 0.1 * k - 0.05) for k in range(-9, 4)]
    found = url_filter.calibrated(spark.createDataFrame(rows, "decided string, ratio double"))

    def mean(t):
        hits = {v: [(r >= t) == (v == "allow") for d, r in rows if d == v] for v in ("allow", "block")}
        return sum(sum(h) / len(h) for h in hits.values()) / 2

    assert mean(found) == pytest.approx(max(mean(t / 1000) for t in range(-2000, 2000)))


def test_held_out_urls_are_told_apart(spark):
    allow, block = url_filter.held_out_rates(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert (allow + block) / 2 > 0.8
