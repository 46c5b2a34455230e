"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule rejects a document. The cascade first runs every rule over a sample of the documents, which is written once:
that gives its selectivity (the share that it rejects) and its cost (the time it takes for
the sample, less that of a job without a rule). Rules are then ordered by rejection per cost and put into one conditional
expression, so that a document that an early rule rejects is never tested by a later one. The
order changes the work, never the verdict.

Some rules compare the base measures, which every row has anyway and which cost next to nothing; others read the text
in their own way, word by word or line by line. Those are what the order saves: a document that the measures, or a cheaper
rule, reject is not read again.

The measures need no Python and no shuffle: windows of five words are hashed inside the row,
and a text whose windows are all different is recognised with one set operation.

Defined results: null text is the empty text; a text without words fails the rule on the number
of words; repeated rows get a row each, also without a doc_id; an empty table gives an empty result; other columns are
not looked at, whatever their names. Texts and lines may have any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import SPACED_WORD
from evisift.session import written

WINDOW = 5
#: Documents (about) of which costs and selectivities are estimated.
SAMPLE_DOCS = 2_000
#: A rejection share that rules start from, so that a rule that rejects nothing still has a place.
LEAST_SHARE = 1e-4

#: Words with an ASCII letter or anything beyond ASCII.
LETTERED_WORD = r"[^\x20\x09-\x0D]*[^\x00-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*"
BULLET_LINE = r"^[\x20\x09-\x0D]*[-*\x{2022}]"
CUT_LINE = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
SYMBOL = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents to reject; null counts as false."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    share: float
    seconds: float

    @property
    def worth(self) -> float:
        return max(self.share, LEAST_SHARE) / max(self.seconds, 1e-6)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a plain column would be copied to each place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACED_WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACED_WORD))
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(hashes: Column) -> Column:
    """One hash for each run of ``WINDOW`` entries of an array of numbers."""
    ends = F.size(hashes) - (WINDOW - 1)
    at = F.when(ends > 0, F.sequence(F.lit(0), ends - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))


def covered_words(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Windows are sorted by hash with their places, so equal ones are neighbours. The starts of
    those with an equal neighbour, in order, cover five words each, less what is covered already.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        def start(x: Column, k: Column) -> Column:
            twin = F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])
            return F.when(twin, x["i"])

        return F.array_sort(F.filter(F.transform(p, start), lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda i, k: F.least(F.coalesce(F.get(starts, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, gap: n + gap)

    return bound(bound(placed, repeated), covered)


def n_repeat_words(text: Column) -> Column:
    """Only texts with some equal windows are sorted."""
    none = F.lit(0).cast("long")
    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered_words(w)).otherwise(none)
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return bound(hashes, lambda h: bound(window_hashes(h), some))


def with_measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and the base measures of every row of ``docs(doc_id, text)``; and the columns to ``keep``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", *keep, n_words(text).alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(text).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Rules over the columns of ``with_measures``; thresholds are well clear of ordinary prose."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("many_repeats", F.lit(100) * F.col("n_repeat_words") > F.lit(20) * n),
        Rule("many_symbols", F.lit(10) * F.col("n_symbols") > n),
        Rule("short_words", F.col("word_chars") < F.lit(2) * n),
        Rule("long_words", F.col("word_chars") > F.lit(14) * n),
        Rule("repeated_lines", (F.lit(10) * F.col("n_dup_lines") > n) & (F.col("n_dup_lines") >= 3)),
    ]


def content_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACED_WORD))


def share_of_lines(text: Column, pattern: str, percent: int, least: int = 5) -> Column:
    """At least ``least`` lines with a word, and more than ``percent`` of them with the pattern."""
    def many(lines: Column) -> Column:
        return (F.size(lines) >= least) & (100 * F.size(F.filter(lines, lambda x: x.rlike(pattern))) > percent * F.size(lines))

    return bound(content_lines(text), many)


def reading_rules(n: Column) -> list[Rule]:
    """Rules that read ``text`` in a way of their own; ``n`` is its number of words."""
    text = F.coalesce("text", F.lit(""))
    lettered = F.regexp_count(text, F.lit(LETTERED_WORD))
    return [
        Rule("mostly_markup", F.lit(2) * F.regexp_count(text, F.lit("<[A-Za-z/][^<>]*>")) > n),
        Rule("mostly_links", F.lit(4) * F.regexp_count(text, F.lit("https?://")) > n),
        Rule("few_letters", F.lit(100) * lettered < F.lit(40) * n),
        Rule("few_distinct_words", (n >= 100) & (F.size(F.array_distinct(words(text))) <= 15)),
        Rule("mostly_bullets", share_of_lines(text, BULLET_LINE, 90)),
        Rule("cut_lines", share_of_lines(text, CUT_LINE, 60)),
    ]


def text_rules() -> list[Rule]:
    """The rules straight on ``text``, for a pipeline that only filters: a rejected text is not measured further."""
    text = F.coalesce("text", F.lit(""))
    n = n_words(text)
    return [
        Rule("few_words", n < 10),
        Rule("many_symbols", F.lit(10) * n_symbols(text) > n),
        Rule("short_words", word_chars(text) < F.lit(2) * n),
        Rule("long_words", word_chars(text) > F.lit(14) * n),
        Rule("repeated_lines", (F.lit(10) * n_dup_lines(text) > n) & (n_dup_lines(text) >= 3)),
        *reading_rules(n),
    ]


def sampled(docs: DataFrame, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` rows, by a hash of their id, written once."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    bound_of_share = min(2**63 - 1, int((share - 0.5) * 2**64))  # of 64-bit hashes, so that no share rounds to none
    picked = docs.filter(F.xxhash64(F.col("doc_id").cast("string")) <= bound_of_share)
    return written(picked, "sample")


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Selectivity and cost of each rule over the rows of a written sample."""
    rows = max(sample.count(), 1)

    def timed(rejects: Column) -> tuple[int, float]:
        started = time.perf_counter()
        rejected = sample.filter(rejects).count()
        return rejected, time.perf_counter() - started

    for _ in range(2):  # the second is without the cost of starting
        _, idle = timed(F.length(F.coalesce("text", F.lit(""))) < 0)
    found = []
    for rule in rules:
        rejected, seconds = timed(rule.rejects)
        found.append(Estimate(rule.name, rejected / rows, max(seconds - idle, 1e-4)))
    return found


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda rule: (-worth[rule.name], rule.name))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Kept or not, and the rule that rejected; later rules are not tested after a rejection."""
    rejected_by = F.lit(None).cast("string")
    for rule in reversed(rules):
        rejected_by = F.when(rule.rejects, F.lit(rule.name)).otherwise(rejected_by)
    return rejected_by.isNull(), rejected_by


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by``; rules default to those straight on the text."""
    chosen = text_rules() if rules is None else rules
    kept, rejected_by = verdict(ordered(chosen, estimate(sampled(docs, sample_docs), chosen)))
    return docs.select("*", kept.alias("kept"), rejected_by.alias("rejected_by"))


def judged(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Base measures of every document, ``base_failed``, and the verdict of the cascade."""
    rules = standard_rules() + reading_rules(F.col("n_words"))
    sample = written(with_measures(sampled(docs.select("doc_id", "text"), sample_docs), "text"), "measured")
    kept, _ = verdict(ordered(rules, estimate(sample, rules)))
    measured = with_measures(docs, "text")
    return measured.select("*", base_failed().alias("base_failed"), kept.alias("kept")).drop("text")


#: The same in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{2022}]')) AS n_bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) AS n_cut FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '<[A-Za-z/][^<>]*>')) AS tags, len(regexp_extract_all(t, 'https?://')) AS links,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS lettered,
         len(list_distinct(w)) AS n_distinct, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_cut, 0) AS n_cut
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 14 * n_words OR (10 * n_dup_lines > n_words AND n_dup_lines >= 3)
            OR 2 * tags > n_words OR 4 * links > n_words OR 100 * lettered < 40 * n_words OR (n_words >= 100 AND n_distinct <= 15)
            OR (n_lines >= 5 AND 100 * n_bullets > 90 * n_lines) OR (n_lines >= 5 AND 100 * n_cut > 60 * n_lines)) AS kept
FROM m
"""
