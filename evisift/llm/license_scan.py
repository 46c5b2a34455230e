"""License scans with ordered signature rules, in DataFrame functions alone.

A rule is a regular expression over a text's words (ASCII lower case, joined by one blank), with
a label, a priority and a confidence. Hundreds of rules come from a table of license families:
each name of a family, alone and with each of its versions and their additions. Three gates
keep expressions away from most texts: one expression over the raw text for the hints of all
rules; then each rule's two key words, which must both be among the text's words; only then
the rule itself.

Detections are intervals of words. One that lies inside another of the same or a higher priority
is suppressed; of equal intervals the one with the higher priority stays, then the first label.
The base phrases' labels always stay. The score is the highest confidence among the
detections that are left, 0 without any.

Defined results: null text is empty; texts without a detection have no label, null positions and
score 0. Detections belong to a row, known by the hash of its id and text: equal rows get equal results each, and rows
that share an id, or have none, but differ in their text are scanned each for itself. Other columns are ignored, whatever
their names. Texts may have any length; one with very many detections is sorted by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.llm.common import lower_ascii

#: Characters between words: ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MARK = "\u0001"

LICENSE = "licen[cs]e"

#: Phrases of the base labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families, their names, and their versions.
FAMILIES = {
    "gpl": ([f"gnu general public {LICENSE}", "gnu gpl", f"gpl {LICENSE}", "gpl"], ["1", "2", "3"]),
    "lgpl": ([f"gnu lesser general public {LICENSE}", f"gnu library general public {LICENSE}", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    "agpl": ([f"gnu affero general public {LICENSE}", f"affero general public {LICENSE}", "agpl"], ["1", "3"]),
    "gfdl": ([f"gnu free documentation {LICENSE}", "gfdl"], ["1 1", "1 2", "1 3"]),
    "apache": ([f"apache {LICENSE}", f"apache software {LICENSE}", f"apache public {LICENSE}"], ["1", "1 1", "2"]),
    "mpl": ([f"mozilla public {LICENSE}", f"mpl {LICENSE}"], ["1", "1 1", "2"]),
    "epl": ([f"eclipse public {LICENSE}", f"epl {LICENSE}"], ["1", "2"]),
    "cddl": ([f"common development and distribution {LICENSE}", f"cddl {LICENSE}"], ["1", "1 1"]),
    "eupl": ([f"european union public {LICENSE}", f"eupl {LICENSE}"], ["1", "1 1", "1 2"]),
    "cpl": ([f"common public {LICENSE}"], ["1"]),
    "osl": ([f"open software {LICENSE}"], ["1", "1 1", "2", "2 1", "3"]),
    "afl": ([f"academic free {LICENSE}"], ["1 1", "1 2", "2", "2 1", "3"]),
    "ofl": ([f"sil open font {LICENSE}", f"open font {LICENSE}"], ["1", "1 1"]),
    "artistic": ([f"artistic {LICENSE}", f"perl artistic {LICENSE}"], ["1", "2"]),
    "boost": ([f"boost software {LICENSE}"], ["1"]),
    "odbl": ([f"open database {LICENSE}", f"open data commons open database {LICENSE}"], ["1"]),
    "php": ([f"php {LICENSE}"], ["3", "3 01"]),
    "python": ([f"python software foundation {LICENSE}", f"psf {LICENSE}"], ["2"]),
    "zlib": ([f"zlib {LICENSE}", f"zlib libpng {LICENSE}"], []),
    "isc": ([f"isc {LICENSE}", f"internet systems consortium {LICENSE}"], []),
    "mit": ([f"mit {LICENSE}", f"the mit {LICENSE}", f"expat {LICENSE}", f"x11 {LICENSE}", f"mit x11 {LICENSE}"], []),
    "unlicense": (["the unlicense", f"unlicense {LICENSE}"], []),
    "wtfpl": ([f"do what the fuck you want to public {LICENSE}", f"wtfpl {LICENSE}"], ["1", "2"]),
    "bsd": ([f"bsd {LICENSE}", f"berkeley software distribution {LICENSE}"], []),
    "bsd-2-clause": ([f"bsd 2 clause {LICENSE}", f"2 clause bsd {LICENSE}", f"simplified bsd {LICENSE}", f"freebsd {LICENSE}"], []),
    "bsd-3-clause": ([f"bsd 3 clause {LICENSE}", f"3 clause bsd {LICENSE}", f"new bsd {LICENSE}", f"modified bsd {LICENSE}"], []),
    "bsd-4-clause": ([f"bsd 4 clause {LICENSE}", f"4 clause bsd {LICENSE}", f"original bsd {LICENSE}"], []),
    "cc0": (["cc0", "creative commons zero"], ["1"]),
}
#: Kinds of Creative Commons licenses and how their names go.
COMMONS = {
    "cc-by": ("by", "attribution"), "cc-by-sa": ("by sa", "attribution share ?alike"),
    "cc-by-nd": ("by nd", "attribution no ?deriv(?:ative)?s"), "cc-by-nc": ("by nc", "attribution non ?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
}
COMMONS_VERSIONS = ["1", "2", "2 5", "3", "4"]
#: What may follow a version, and what it adds to the label.
ADDITIONS = {"": "", " or later": "-or-later", " or any later version": "-or-later", " only": "-only"}
#: Sentences of license texts: label, expression, key words.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission", "hereby")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission", "distribute")),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ("redistribution", "binary")),
    ("gpl", f"free software you can redistribute it and or modify it under the terms of the gnu general public {LICENSE}", ("redistribute", "gnu")),
    ("apache", f"you may not use this file except in compliance with the {LICENSE}", ("compliance", "except")),
    ("public-domain", "released into the public domain", ("public", "domain")),
    ("public-domain", "dedicated to the public domain", ("public", "domain")),
    ("proprietary", "all rights reserved", ("rights", "reserved")),
]

#: Priorities: a versioned name outranks a sentence, that a bare name, that a base phrase.
VERSIONED, SENTENCE, NAMED, PHRASE = 4, 3, 2, 1
CONFIDENCE = {VERSIONED: 0.95, SENTENCE: 0.9, NAMED: 0.75, PHRASE: 0.6}

#: Every rule needs one of these in the raw text, in any case.
HINTS = rf"(?i)licen[cs]e|gpl|gfdl|cc0|cc{GAP}+by|creative{GAP}+commons|hereby|redistribut|public{GAP}+domain|rights{GAP}+reserved|distribute"


@dataclass(frozen=True)
class SignatureRule:
    label: str
    pattern: str
    priority: int
    key: str
    also: str
    base: bool = False


def plain_words(pattern: str) -> list[str]:
    """Words that stand in every text of an expression: not those with alternatives, nor those that may be run together."""
    return [w for w in re.split(r" (?!\?)", pattern) if w.isalnum()]


def version_pattern(name: str, version: str, addition: str) -> str:
    number = version + ("(?: 0)?" if " " not in version else "")
    return f"{name} (?:version |ver |v )?(?:v)?{number}{addition}"


def rules() -> list[SignatureRule]:
    """All rules. Key words are the rarest-looking words of the expression: its first and its last plain one."""
    found: dict[str, SignatureRule] = {}

    def add(label: str, pattern: str, priority: int, key: str, also: str, base: bool = False) -> None:
        found.setdefault(f"{pattern}|{label}|{base}", SignatureRule(label, pattern, priority, key, also, base))

    named = [(label, name, versions) for label, (names, versions) in FAMILIES.items() for name in names]
    named += [
        (label, name, COMMONS_VERSIONS)
        for label, (short, long) in COMMONS.items() for name in (f"cc {short}", f"creative commons {long}")
    ]
    for label, name, versions in named:
        words = plain_words(name)
        key, also = words[0], words[-1]
        add(label, name, NAMED, key, also)
        for version in versions:
            tag = version.replace(" ", ".")
            for addition, suffix in ADDITIONS.items():
                add(f"{label}-{tag}{suffix}", version_pattern(name, version, addition), VERSIONED, key, also)
            if words == [name]:  # one word, such as gplv3
                add(f"{label}-{tag}", f"{name}v{version}(?: 0)?", VERSIONED, f"{name}v{version.split(' ')[0]}", "")
    for label, pattern, (key, also) in SENTENCES:
        add(label, pattern, SENTENCE, key, also)
    for phrase, label in BASE.items():
        add(label, phrase, PHRASE, phrase.split(" ")[0], phrase.split(" ")[-1], base=True)
    return list(found.values())


def normal(text: Column) -> Column:
    """The text's words, each between single blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), GAP + "+", " ")), F.lit(" "))


def identified(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: ``row`` stands for the pair of the other two."""
    return docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "doc_id", "text")


def detections(docs: DataFrame, chosen: list[SignatureRule] | None = None) -> DataFrame:
    """Every place where a rule's words stand: ``row, doc_id, label, priority, confidence, base, start, end`` (words, end exclusive)."""
    chosen = rules() if chosen is None else chosen
    table = docs.sparkSession.createDataFrame(
        [(r.key, r.also, rf"(?<= ){r.pattern}(?= )", r.label, r.priority, CONFIDENCE[r.priority], r.base) for r in chosen],
        "key string, also string, pattern string, label string, priority int, confidence double, base boolean",
    )
    keys = F.array(*(F.lit(k) for k in sorted({r.key for r in chosen})))
    hinted = identified(docs).filter(F.col("text").rlike(HINTS)).select("row", "doc_id", normal(F.col("text")).alias("_normal"))
    keyed = hinted.select("row", "doc_id", "_normal", F.explode(F.array_intersect(F.split("_normal", " "), keys)).alias("key"))
    # as large as the list of rules
    met = keyed.join(F.broadcast(table), "key").filter(
        ((F.col("also") == "") | F.col("_normal").contains(F.concat(F.lit(" "), "also", F.lit(" ")))) & F.expr("_normal rlike pattern")
    )
    marked = F.regexp_replace(F.col("_normal"), F.concat(F.lit("("), "pattern", F.lit(")")), F.lit(MARK + "$1"))
    starts = F.filter(
        F.transform(F.split(F.trim(marked), " "), lambda w, i: F.when(w.startswith(MARK), i)), lambda i: i.isNotNull()
    )
    found = F.regexp_extract_all(F.col("_normal"), F.col("pattern"), F.lit(0))
    places = F.arrays_zip(starts.alias("start"), F.transform(found, lambda m: F.size(F.split(m, " "))).alias("words"))
    return met.select("row", "doc_id", "label", "priority", "confidence", "base", F.explode(places).alias("p")).select(
        "row", "doc_id", "label", "priority", "confidence", "base", F.col("p")["start"].cast("long").alias("start"),
        (F.col("p")["start"] + F.col("p")["words"]).cast("long").alias("end"),
    )


def suppressed(found: DataFrame) -> DataFrame:
    """``found`` with ``stays``: not inside another detection of the same or a higher priority."""
    before = (
        Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "label", "base")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.lit(False)
    for level in (PHRASE, NAMED, SENTENCE, VERSIONED):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        inside = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(inside)
    return found.withColumn("stays", ~inside)


def scan(docs: DataFrame, chosen: list[SignatureRule] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, with its words, base phrases, labels and score."""
    base = F.col("base")
    found = suppressed(detections(docs, chosen).distinct())
    listed = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    per_row = found.groupBy(F.col("row").alias("_row")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.when(base | F.col("stays"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("stays"), F.col("confidence"))).alias("score"),
    )
    counted = identified(docs).select("row", "doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    return counted.join(per_row, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
