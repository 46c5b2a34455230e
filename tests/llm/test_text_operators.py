"""Language-model scores, BPE, quality rules, decontamination, URL filters, HTML, classifier: against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from evisift.llm import (
    bpe, decontamination, html_extraction, lm_scoring, quality_classifier, quality_rules, queries, url_filter,
)
from evisift_checks.compare import connect, rows_of

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "one", "A a A a", "x" * 5000, "word " * 3000, "one two\r\nthree\tfour", "ÉCOLE École 東京 ١٢٣ Ⅷ",
    "<|endoftext|>and<|endoftext|>", "it's  we'll   \n\n  they'd", "\u1680a\u2003b\x85c\x1cd", "\U00010940x \U000323b0 y", "a\x00b", "🙂🙂 👩‍👩‍👧",
]


def table(spark, texts, more=""):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


# --- language-model scoring ---


def plain_scores(rows, mass):
    docs = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    ones, twos = collections.Counter(), collections.Counter()
    for i, w in docs:
        if not held[i]:
            ones.update(w)
            twos.update(zip([None, *w], w))
    n, v = sum(ones.values()), len(ones)
    out = {}
    for i, w in docs:
        p = lambda x: (ones[x] + 1) / (n + v + 1)
        score = sum(math.log10((twos[h, x] + mass * p(x)) / (ones[h] + mass)) for h, x in zip([None, *w], w))
        out[i] = (held[i], len(w), sum(ones[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score)
    return out


@pytest.mark.parametrize("source", ["odd", "given"])
def test_lm_scores(spark, source):
    docs = given(spark) if source == "given" else table(spark, ODD)
    rows = [tuple(r) for r in docs.collect()]
    expected = plain_scores(rows, lm_scoring.BACKOFF_MASS)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    assert set(got) == set(expected)
    for i, (held, n, known, total, base, score) in expected.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_lm_beats_unigrams_on_held_out(spark):
    held = [r for r in lm_scoring.score(given(spark)).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_of_nothing(spark):
    assert lm_scoring.score(table(spark, [])).collect() == []


# --- BPE ---


@pytest.mark.parametrize("source", ["odd", "given"])
def test_bpe_equals_the_library(spark, source):
    docs = given(spark) if source == "given" else table(spark, ODD)
    tokenizer = bpe.tokenizer(queries.TOKENIZER)
    texts = dict(docs.collect())
    got = bpe.encode(docs, queries.TOKENIZER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), decoded)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_of_nothing(spark):
    assert bpe.encode(table(spark, []), queries.TOKENIZER, texts=False).collect() == []


# --- SQL twins ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_twin(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    cursor = connect(SMALL).execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


# --- quality rules ---


def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f a b c d e", "a a a a a a a", "l\nl\nm\n\n \nl", "#*$%&|<> x"]
    got = quality_rules.judged(table(spark, texts)).collect()
    for r in got:
        n, chars, symbols, lines, repeats = plain_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = table(spark, ["word " * 3, " ".join(f"w{i}" for i in range(40)), "## " * 30, None])
    rules = quality_rules.text_rules()
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.cascade(docs, rules).collect()}
    assert kept == {0: False, 1: True, 2: False, 3: False}
    estimates = [quality_rules.Estimate(r.name, 0.5 if r.name == "long_words" else 0.1, 1.0) for r in rules]
    assert quality_rules.ordered(rules, estimates)[0].name == "long_words"
    assert quality_rules.judged(table(spark, [])).collect() == []


def test_a_costly_rule_is_skipped_for_rejected_rows(spark):
    texts = ["w " * 3] * 30 + [" ".join(f"w{i}" for i in range(40 + k)) for k in range(30)]
    docs = table(spark, texts)
    short = quality_rules.n_words(quality_rules.F.col("text")) < 10
    # reading a short text with this rule ends the job
    costly = quality_rules.F.when(short, quality_rules.F.raise_error(quality_rules.F.lit("read after all")).cast("boolean")).otherwise(
        quality_rules.n_repeat_words(quality_rules.F.col("text")) > 99)
    rules = [quality_rules.Rule("costly", costly), quality_rules.Rule("few_words", short)]
    cheap_first = quality_rules.ordered(rules, [quality_rules.Estimate("costly", 0.5, 2.0), quality_rules.Estimate("few_words", 0.5, 0.01)])
    assert [r.name for r in cheap_first] == ["few_words", "costly"]
    kept, by = quality_rules.verdict(cheap_first)
    assert docs.select(by.alias("by")).groupBy("by").count().collect() and docs.filter(kept).count() == 30
    with pytest.raises(Exception, match="read after all"):
        docs.filter(quality_rules.verdict(rules)[0]).count()


def test_costs_come_from_a_sample_written_once(spark, monkeypatch):
    written = []
    real = quality_rules.written
    monkeypatch.setattr(quality_rules, "written", lambda t, name: written.append(real(t, name)) or written[-1])
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 30) AS text")
    assert 0 < quality_rules.sampled(docs, 40).count() < 120
    found = quality_rules.estimate(written[0], quality_rules.text_rules())
    assert [e.name for e in found] == [r.name for r in quality_rules.text_rules()] and all(e.seconds > 0 for e in found)
    assert {e.name for e in found if e.share == 1.0} == set()
    quality_rules.judged(docs, 40)
    assert len(written) == 3  # the sample, and its measures


def test_rules_that_read_the_text(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    texts = {
        "mostly_markup": "<b>one</b> <i>two</i> " * 9, "mostly_links": "see http://a/b and https://c " * 9, "few_letters": "12 34 5.6 x " * 9,
        "few_distinct_words": " ".join("abcdefghijkl"[i % 12] + "oo" for i in range(120)), "mostly_bullets": "\n".join(f" - item number {i} of it" for i in range(9)),
        "cut_lines": "\n".join(f"line {i} goes on and ..." for i in range(9)), None: prose,
    }
    n = quality_rules.n_words(quality_rules.F.col("text"))
    _, by = quality_rules.verdict(quality_rules.reading_rules(n))
    docs = table(spark, list(texts.values()))
    got = {r.doc_id: r.by for r in docs.select("doc_id", by.alias("by")).collect()}
    assert got == dict(enumerate(texts))


def test_quality_of_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, " ".join(f"w{i}" for i in range(30))), (1, "x"), (2, None), (3, "y" * 100_000 + " z" * 20)]
    docs = spark.createDataFrame([(i, t, 9, True, "n") for i, t in rows], "doc_id long, text string, n_words int, kept boolean, rejected_by string")
    got = sorted(str((r.doc_id, r.n_words, r.base_failed, r.kept)) for r in quality_rules.judged(docs.repartition(2)).collect())
    assert got == sorted(map(str, [(None, 3, True, False), (None, 3, True, False), (1, 30, False, True), (1, 1, True, False), (2, 0, True, False), (3, 21, True, False)]))


# --- decontamination ---


def test_decontamination_in_blocks(spark):
    docs = table(spark, [None, "", "Say: one, two three four five six seven eight nine TEN eleven twelve!", "short item", "not here", "short  ITEM short item"])
    items = [(10, "one two three four five six seven eight nine ten eleven"), (2, "Short Item"), (3, None), (4, "..."), (5, "short item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(decontamination.find(docs, bench, block_chars=b).collect()) for b in (10**6, 20))
    assert [tuple(r) for r in whole] == [tuple(r) for r in parts]
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in whole] == [
        (0, 0, 0, []), (1, 0, 0, []), (2, 13, 11, ["10"]), (3, 2, 2, ["2", "5"]), (4, 2, 0, []), (5, 4, 4, ["2", "5"]),
    ]
    assert [(s["start"], s["end"]) for s in whole[2]["spans"]] == [(5, 61)]
    assert sorted(r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()) == [0, 1, 4]
    none = bench.filter("false")
    assert decontamination.clean_documents(docs, none).count() == 6


def test_decontamination_splits_both_sides_at_the_same_places(spark):
    """No-break, ideographic and other spaces beyond ASCII are inside words, of items and of documents."""
    texts = [f"one{c}two three" for c in "\u00a0\u3000\u2003\u0085 "] + [
        " ".join(f"w{k}" for k in range(8)) + f" end{c}of it all" for c in "\u00a0\u3000\u0085 "
    ]
    docs = table(spark, texts)
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, text string")
    for chars in (10**6, 40):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontamination.find(docs, bench, block_chars=chars).collect()}
        for k, t in enumerate(texts):
            n = len([w for w in t.split(" ") if w])
            assert got[k] == (n, n, [f"i{k}"])


# --- URL filters ---

URLS = [
    None, "", "no scheme", "http://a.b.NET/x", "https://www.example.net/en/1?q#f", "http://example.net/english", "http://notexample.com/de/",
    "https://Example.COM/de/4", "http://shop.example.com/de", "https://x.org/fr/2", "https://xorg/fr/2", "http://h?q=/a", "a://b://c/d", "http://org/fr/",
]


def plain_url(url):
    m = re.search(r"://([^/?#]*)(/[^?#]*)?", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = (m[2] or "") if m else ""
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best


def test_decontamination_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 14)
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(12))
    rows = [(1, f"x {a} y"), (1, f"x {a} y"), (1, b), (None, b), (None, "nothing here"), (None, f"{b} {a}"), (2, None), (3, "s t"), (4, "z s t z")]
    docs = spark.createDataFrame([(i, t, "r", 1, "h") for i, t in rows], "doc_id long, text string, row string, n_hit int, _hit_row string").repartition(3)
    bench = spark.createDataFrame([("q1", a, 1), ("q2", b, 1), (None, b, 1), (None, "s t", 1), ("q1", "s t", 1), ("q3", None, 1), ("q4", "!", 1)], "item_id string, text string, row int")
    want = sorted(map(str, [
        (1, 42, 40, ["q1"]), (1, 42, 40, ["q1"]), (1, 12, 12, ["q2", None]), (None, 12, 12, ["q2", None]), (None, 2, 0, []),
        (None, 52, 52, ["q1", "q2", None]), (2, 0, 0, []), (3, 2, 2, ["q1", None]), (4, 4, 2, ["q1", None])]))
    spans = []
    for chars in (None, 10**6, 60):
        got = decontamination.find(docs, bench, block_chars=chars).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got) == want, chars
        spans.append(sorted(str((r.doc_id, r.hit_words, r.spans)) for r in got))
        kept = decontamination.clean_documents(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == ["(2, None)", "(None, 'nothing here')"]
    assert spans[0] == spans[1] == spans[2]
    digest = {r.doc_id: (r.n_items, r.items_sha256) for r in decontamination.digest(decontamination.find(docs, bench)).collect() if r.doc_id in (3, 4)}
    assert digest[3] == digest[4] == (2, hashlib.sha256(b"q1").hexdigest())


def test_an_automaton_stays_within_its_bound():
    text = " ".join(f"word{k}" for k in range(3000))
    machine = decontamination.automaton((("q", text),))
    assert machine.get_stats()["nodes_count"] <= decontamination.WINDOW_WORDS * (len(text) + 2)
    assert decontamination.automaton((("q", text),)) is machine


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in url_filter.judge(pages).collect():
        host, path, rule = plain_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_url_model_tells_the_classes_apart(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = url_filter.judge(pages).collect()
    decided = [r for r in judged if r["rule"]]
    mean = lambda v: [r["ratio"] for r in decided if next(x for x in url_filter.RULES if x.name == r["rule"]).verdict == v]
    allow, block = mean("allow"), mean("block")
    assert sum(allow) / len(allow) > sum(block) / len(block)
    assert url_filter.judge(pages.filter("false")).collect() == []


# --- HTML extraction ---


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "template", "noscript"])
@pytest.mark.parametrize("later", ["", "<footer><button>Send</button><select><option>x</select></footer>"])
def test_unclosed_elements_before_the_article(tag, later):
    page = html_extraction.Page(f"<body><header>Site <{tag} class=menu>Menu <i>open</i></header><article><p>First words.</p><p>Second.</p></article>{later}")
    text = page.main_text([True] * len(page.tags))
    assert text.split("\n")[:3] == ["Site", "First words.", "Second."]
    bare = html_extraction.Page(f"<{tag}>Menu<article><p>First words.</p></article>")
    assert bare.main_text([True] * len(bare.tags)) == "First words."


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "iframe"])
def test_raw_text_goes_to_the_end(tag):
    page = html_extraction.Page(f"<p>Before</p><{tag}><p>inside</p>")
    assert page.main_text([True] * len(page.tags)) == "Before"



def test_html_of_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in html_extraction.extract(pages).collect()}
    wrong = 0
    for page in pages.collect():
        inner = page["html"].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html_extraction.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        wrong += got[page["page_id"]]["text"] != "\n".join(b for b in blocks if b)
        assert got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])
    assert wrong <= 0.02 * len(got)


def test_html_parts_of_a_page(spark):
    article = "<h1>Title of it</h1><p>First &amp; foremost,\n this is &eacute;crit.<p>Second one with <b>bold <i>words</b> in</i> it.<ul><li>item one here<li>item two here</ul>"
    junk = (
        '<div id="cookie-notice">We use cookies for this</div>', '<section class="comments"><div class="comment"><p>I liked reading this</p></div></section>',
        '<aside><p>See also this prose</p></aside>', '<form><p>Sign up for letters</p><input></form>', '<script>if (a < b) x("</p>")</script>', "<!-- <p>no</p> -->",
    )
    pages = [(0, None), (1, ""), (2, f"<html><body><nav><a href=/>Home</a></nav>{''.join(junk)}<article>{article}{junk[0]}{junk[3]}</article><footer>Copyright us</footer>")]
    pages += [(3, "<p>" * 3000 + "deep"), (4, "<a href='x" * 200), (2 + 3, pages[2][1])]
    frame = spark.createDataFrame([(i, f"http://u/{i}", h, "x") for i, h in pages], "page_id long, url string, html string, text string")
    lines = spark.read.parquet(f"{SMALL}/pages.parquet").limit(40).selectExpr("page_id + 100 AS page_id", "url", "html", "'x' AS text")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(frame.union(lines)).collect()}
    assert got[0] == got[1] == ""
    assert got[2] == got[5] == "Title of it\nFirst & foremost, this is écrit.\nSecond one with bold words in it.\nitem one here\nitem two here"
    assert html_extraction.extract(frame.filter("false")).collect() == []


def test_marks_of_training_pages_on_given_ones(spark):
    pages = ["<div data-made><p>one", '<div class="data-made"><p>two</div>', "<p data-made=>three", "<p data-made=1>four", "<p data-made"]
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)] * 2, "page_id long, url string, html string")
    assert html_extraction.extract(frame).count() == 10
    assert all(set(html_extraction.Page(h).label) == {""} for h in pages)
    assert html_extraction.Page("<p data-made=1>x", made=True).label == ["", "1"]


HOSTILE = {
    "unclosed tags": "<a " * 20_000, "open headings": "<h1>" * 15_000, "bold then paragraphs": "<b>" * 10_000 + "<p>x" * 10_000,
    "list in bold": "<li><ul>" + "<b>" * 10_000 + "<li>x" * 10_000, "stray ends": "<i><p>" + "<b>" * 10_000 + "</i>" * 10_000,
    "quotes": "<a href='x" * 8_000, "double quotes": '<a "' * 15_000 + ">", "comments": "<!-- " * 12_000, "ends": "</div>" * 10_000,
    "classes": "<p " + "class=" * 10_000 + ">x", "nested": "<div>" * 12_000 + "x" + "</div>" * 12_000, "less": "<" * 60_000, "buttons": "<button>" * 8_000,
    "mixed quotes": "<a '\">" * 9_000, "cells": "<table><tr>" + "<td><b>" * 9_000, "svg": "<svg>" * 12_000 + "<p>x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    import time

    html_extraction.Page(HOSTILE[name][:500])
    began = time.process_time()
    page = html_extraction.Page(HOSTILE[name])
    page.main_text([True] * len(page.tags))
    assert time.process_time() - began < 1.0


def test_decoding_never_contradicts():
    import numpy as np

    page = html_extraction.Page("<body><div><p>a<p>b</div><div><section><p>c</section></div></body>")
    draw = np.random.default_rng(1)
    for _ in range(50):
        keep = page.decode(draw.normal(size=len(page.tags)) * 3)
        assert all(keep[page.parents[i]] or not keep[i] for i in range(1, len(page.tags)))


# --- quality classifier ---


def test_classifier_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    assert len(scored) == docs.count()
    right = [scored[r["doc_id"]]["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in labels.collect()]
    assert sum(right) >= 0.95 * len(right)
    kept = {r["doc_id"] for r in quality_classifier.good_documents(docs, labels).collect()}
    assert kept == {i for i, r in scored.items() if r["kept"]}


def test_classifier_defined_cases(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ODD)], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(docs, none).count() == len(ODD)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, None), (4, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, labels).collect()}
    assert not scored[0] and not scored[1]
    assert quality_classifier.score(docs.filter("false"), labels).collect() == []
    assert quality_classifier.good_documents(docs, labels).columns == docs.columns


def test_expectation_maximisation_finds_good_labellers():
    import numpy as np

    draw = np.random.default_rng(4)
    truth = draw.random(4000) < 0.3
    vote = lambda right, silent: np.where(draw.random(4000) < silent, 0, np.where((draw.random(4000) < right) == truth, 1, -1))
    votes = np.column_stack([vote(0.9, 0.2), vote(0.8, 0.3), vote(0.6, 0.1), vote(0.95, 0.6)])
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    bad = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert ((bad > 0.5)[which.ravel()] == truth).mean() > 0.9


def test_words_reach_the_tokenizer_in_portions(monkeypatch):
    import numpy as np
    import public_tokenizers

    from evisift.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = np.array([f" word{k}" for k in range(25)] + ["\n", "é"], object)
    whole = bpe.encode_words(words, path).tolist()
    real, sizes = bpe.tokenizer(path), []

    class Counting:
        def encode_batch(self, given, **how):
            sizes.append(len(given))
            return real.encode_batch(given, **how)

    def counting(_):
        return Counting()

    counting.cache_clear = lambda: None
    monkeypatch.setattr(bpe, "tokenizer", counting)
    monkeypatch.setattr(bpe, "ENCODED_WORDS", 10)
    assert bpe.encode_words(words, path).tolist() == whole
    assert sizes == [10, 10, 7]
