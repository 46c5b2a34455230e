"""Vocabulary terms in text.

A term matches where one of its surface forms stands in the text, whatever the case,
not flanked by a letter or digit; a space in a surface form stands for one or more of
white space, ``-`` and ``_``.

The match is an equi-join in either of two forms, and nothing is ever compared pair by pair.
A :class:`Vocabulary` is an object of the driver, so its size is bounded and its rows are
broadcast: the distinct letter/digit runs of a text that begin a form (of a vocabulary with many first runs: all)
are exploded and joined to the surface forms by the first run of each form; forms of several runs are confirmed on
the few rows that remain. A vocabulary *table* may have any size and meets the texts' word n-grams
(:mod:`evisift.operators.phrases`), so that no text crosses an exchange.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import SPACE_CLASS, TREE_WORDS, escape, strip, word_tree
from evisift.operators.phrases import match_grams
from evisift.operators.sections import source_of
from evisift.vocabulary import Vocabulary

TERM_COLUMNS = ["grp", "canonical", "term_ord", "tier", "surface"]
NOT_ALNUM = r"\P{Alnum}+"  # ASCII letters and digits only

#: First characters that share a tree of first runs.
FIRSTS = 6

EVIDENCE_GROUP = {"python": "python", "ai": "ai"}


def surface_table(spark, vocab: Vocabulary) -> DataFrame:
    """The join side of a vocabulary object, a local relation of known size."""
    table = vocab.table(spark)
    surface = F.lower("surface")
    escaped = F.regexp_replace(surface, r"([^a-z0-9 _])", r"\\$1")
    pattern = F.replace(escaped, F.lit(" "), F.lit(rf"[{SPACE_CLASS}\-_]+"))
    return table.select(
        F.regexp_extract(surface, "[a-z0-9]+", 0).alias("_head"),
        F.element_at(F.split(surface, " "), -1).alias("_tail"),
        surface.rlike("^[a-z0-9]+$").alias("_single"),
        F.concat(F.lit("(?<![a-z0-9])"), pattern, F.lit("(?![a-z0-9])")).alias("_pattern"),
        "grp", "canonical", "tier", "surface",
        F.struct("grp_ord", "ord").alias("term_ord"),
    )


def first_runs(lowered: str, vocab: Vocabulary) -> Column:
    """The letter/digit runs of a lowered text that may begin a surface form; of a large vocabulary, all of them."""
    heads = {run.group() for e in vocab.entries if (run := re.search("[a-z0-9]+", e.surface.lower()))}
    if len(heads) > TREE_WORDS:
        return F.split(lowered, NOT_ALNUM)
    # a tree for every few first characters: of a run that begins otherwise, only these are looked at
    firsts = sorted({head[0] for head in heads})
    groups = [firsts[i : i + FIRSTS] for i in range(0, len(firsts), FIRSTS)]
    trees = [f"(?=[{''.join(g)}])" + word_tree(head for head in heads if head[0] in g) for g in groups]
    wanted = f"[^a-z0-9]({'|'.join(trees) or '(?!)'})(?![a-z0-9])"
    return F.regexp_extract_all(F.concat(F.lit(" "), F.col(lowered)), F.lit(wanted), F.lit(1))


def match_rows(
    units: DataFrame,
    keys: Sequence[str],
    body: str,
    vocab: Vocabulary | DataFrame,
    carry: Column | None = None,
) -> DataFrame:
    """``keys`` plus a row for every surface form found in ``body``, once for each of its first runs.

    Rows for which ``carry`` holds pass through once with NULL terms, so per-document
    columns can travel with the hits in the same scan.
    """
    if not isinstance(vocab, Vocabulary):
        return match_grams(units, keys, body, vocab, TERM_COLUMNS, carry)
    surfaces = surface_table(units.sparkSession, vocab)
    lowered = units.withColumn("_body", F.lower(F.col(body)))
    # a text is confirmed once per form, however often the form's first run occurs
    tokens = F.array_distinct(first_runs("_body", vocab))
    exploded = lowered.select(*keys, "_body", F.explode_outer(tokens).alias("_token"))
    found = F.col("_single") | (
        F.contains("_body", "_tail") & F.rlike("_body", "_pattern")
    )
    how, keep = ("inner", found) if carry is None else ("left", found | carry)
    joined = exploded.join(surfaces, F.col("_token") == F.col("_head"), how)
    return joined.filter(keep).select(*keys, *TERM_COLUMNS)


def terms_in_text(
    docs: DataFrame, vocab: Vocabulary | DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, grp, canonical, term_ord, tier)``: the terms of the whole text."""
    return match_rows(docs, [key], text, vocab).drop("surface").distinct()


def skills(
    docs: DataFrame, vocab: Vocabulary | DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, skills)``: distinct term names of a text in vocabulary order."""
    hits = match_rows(docs, [key], text, vocab)
    return hits.groupBy(key).agg(skill_list(F.collect_set(F.struct("term_ord", "canonical"))).alias("skills"))


def skill_list(terms: Column) -> Column:
    """Distinct names from ``(term_ord, canonical)`` pairs, in vocabulary order."""
    return F.array_distinct(F.transform(F.array_sort(terms), lambda t: t["canonical"]))


def evidence_group(grp: Column) -> Column:
    """Evidence is kept in three lists: python, ai and other."""
    return F.when(grp.isin(*EVIDENCE_GROUP), grp).otherwise("other")


def evidence(
    lines: DataFrame, vocab: Vocabulary | DataFrame, context_chars: int = 140
) -> DataFrame:
    """``(doc_id, evidence_group, term, source, context, line_no, term_ord)``.

    One row per distinct term, source and context, at its first line.
    """
    units = lines.select(
        "doc_id", "line_no", "line",
        source_of(F.col("section")).alias("source"),
        F.left(strip(F.col("line")), F.lit(context_chars)).alias("context"),
    )
    hits = match_rows(units, ["doc_id", "line_no", "source", "context"], "line", vocab)
    return hits.groupBy(
        "doc_id",
        evidence_group(F.col("grp")).alias("evidence_group"),
        F.col("canonical").alias("term"),
        "source",
        "context",
    ).agg(F.min("line_no").alias("line_no"), F.min("term_ord").alias("term_ord"))


def term_names(evidence_rows: DataFrame) -> DataFrame:
    """``(doc_id, names)``: distinct term names in evidence order."""
    first = evidence_rows.groupBy("doc_id", "term").agg(
        F.min(F.struct("line_no", "term_ord")).alias("at")
    )
    return first.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]
        ).alias("names")
    )


def any_term(text: Column, vocab: Vocabulary, names, groups=None) -> Column:
    """TRUE when any of the named terms stands in ``text``.

    One literal pattern, compiled once per task; meant for short texts where only
    presence matters.
    """
    surfaces = vocab.surfaces(names, groups)
    if not surfaces:
        return F.lit(False)
    forms = "|".join(escape(s).replace(" ", rf"[{SPACE_CLASS}\-_]+") for s in surfaces)
    return F.lower(text).rlike(f"(?<![a-z0-9])(?:{forms})(?![a-z0-9])")
