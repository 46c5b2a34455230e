"""Vocabularies of any size: an equi-join on word n-grams.

A surface form is a sequence of letter/digit runs with something between them. Where it
matches, the text has the same runs with the same things between them, a space of the form standing for
any white space, ``-`` and ``_``. So a form and every place it matches share one *core*: from the first
run to the last, each such stretch between them written as one space. Texts explode
to the distinct cores they hold, for the numbers of runs that the vocabulary has; forms join on the whole core.
What the form asks before its first and after its last run (``c++``, ``.net``) is checked on the few
characters around the core that travel with it.

So neither the text nor a single unselective word crosses an exchange, and a row that does is as long as a form.
Rows of one core, however frequent, are dealt over ``SPREAD`` tasks. The forms of a large vocabulary are not repeated for
these tasks: they cross one exchange, once, and so do the n-grams, as two hashes of the core (96 bits) and what little differs
from a core between blanks; a core that a large share of the n-grams has is left to Spark's splitting of skewed joins. Of a small
one, the first runs are part of the pattern, so a text explodes to n-grams that begin like a form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import SPACE_CLASS, TREE_WORDS, word_tree

#: Tasks that the rows of one core are dealt over; every form stands once in each.
SPREAD = 8
#: With more forms, they are not repeated.
MANY_FORMS = 100_000
#: Up to so many cores of exact forms are listed, so that no other n-gram asks for them.
EXACT_LISTED = 20_000
VOCAB = ("grp", "grp_ord", "canonical", "ord", "surface", "tier")
GLUE = rf"[{SPACE_CLASS}\-_]+"
INNER = r"(?s)^[^a-z0-9]*(.*[a-z0-9])"  # a form from its first to its last run
EDGE = "\x00"  # stands for nothing where the text begins and ends
#: The same as :data:`GLUE` in the form that Java matches fastest.
FAST_GLUE = r"(?U)[\s\x1c-\x1f_\-]+"


def core_of(text: Column) -> Column:
    return F.regexp_replace(text, FAST_GLUE, " ")


def is_exact(surface: Column) -> Column:
    """TRUE for a lowered form that has more than single blanks between what it is made of, or white space, ``-`` or ``_`` at its ends."""
    return (core_of(surface) != surface) | surface.rlike(f"^{FAST_GLUE}") | surface.rlike(f"{FAST_GLUE}$")


def forms(vocab: DataFrame, *also: str) -> DataFrame:
    """The surface forms of a vocabulary table with their cores, and what they ask around them.

    ``_exact`` is the pattern of the few forms of which a core says too little (such as ``fine-tuning``, where nothing but the
    hyphen will do); else NULL.
    """
    surface = F.lower("surface")
    inner = F.regexp_extract(surface, INNER, 1)
    lead = F.regexp_extract(surface, "(?s)^[^a-z0-9]*", 0)
    trail = F.regexp_extract(surface, "(?s)[^a-z0-9]*$", 0)
    exact = is_exact(surface)
    escaped = F.regexp_replace(surface, r"([^a-z0-9 _])", r"\\$1")
    pattern = F.replace(escaped, F.lit(" "), F.lit(GLUE))
    bounded = F.concat(F.lit("(?<![a-z0-9])"), pattern, F.lit("(?![a-z0-9])"))
    return vocab.select(
        core_of(inner).alias("_core"), lead.alias("_lead"), trail.alias("_trail"),
        F.size(F.regexp_extract_all(surface, F.lit("[a-z0-9]+"), F.lit(0))).alias("_runs"),
        F.when(exact, bounded).alias("_exact"),
        "grp", "canonical", "tier", "surface",
        F.struct("grp_ord", "ord").alias("term_ord"),
        *also,
    )


def shape(vocab: DataFrame) -> tuple[dict[int, int], int, int]:
    """The longest core by the number of runs that forms have, the characters to look at on either side, and how many forms: a row for each number of runs."""
    asked = forms(vocab).groupBy("_runs").agg(
        F.max(F.length("_core")).alias("longest"),
        F.max(F.greatest(F.length("_lead"), F.length("_trail"))).alias("beside"),
        F.count("*").alias("forms"),
    ).orderBy("_runs").collect()
    longest = {row["_runs"]: row["longest"] for row in asked if row["_runs"] and row["_runs"] > 0}
    return longest, max((row["beside"] or 0 for row in asked), default=0) + 1, sum(row["forms"] for row in asked)


def first_run() -> Column:
    return F.regexp_extract("_core", "[a-z0-9]+", 0)


def heads_by_runs(vocab: DataFrame, n_forms: int) -> dict[int, list[str]]:
    """The first runs of forms, by the number of runs; nothing where there are more than a pattern should hold."""
    if n_forms > TREE_WORDS:
        return {}
    rows = forms(vocab).select("_runs", first_run().alias("head")).distinct().collect()
    out: dict[int, list[str]] = {}
    for row in rows:
        out.setdefault(row["_runs"], []).append(row["head"])
    return out


def gram_pattern(runs: int, beside: int, heads: Sequence[str] | None = None) -> str:
    """Captures, at every place where they stand, ``runs`` runs with what stands beside them.

    What stands beside is what is neither letter nor digit, up to ``beside`` characters; where it is shorter, a run is next to it.
    ``heads``: what the first run may be, where not all are wanted.
    """
    other = "[^a-z0-9]"
    before = f"(?:(?<!{other}){other}{{1,{beside}}}|{other}{{{beside}}})"
    first = "[a-z0-9]++" if heads is None else f"{word_tree(heads)}(?![a-z0-9])"
    more = f"(?:{other}++[a-z0-9]++){{{runs - 1}}}" if runs > 1 else ""
    return f"(?=({before}{first}{more}{other}{{1,{beside}}}))"


def grams(
    body: Column, longest: dict[int, int], beside: int, heads: dict[int, list[str]] | None = None, carried: Column | None = None,
) -> Column:
    """The distinct n-grams of a text, each with the characters beside it (``_gram``) and its core (``_own``).

    Those with a core longer than any form of as many runs are left out, but not of a text that is ``carried``.
    """
    edge = EDGE * beside
    padded = F.concat(F.lit(edge), F.lower(body), F.lit(edge))

    def cored(gram: Column) -> Column:
        return F.struct(gram.alias("_gram"), core_of(F.regexp_extract(gram, INNER, 1)).alias("_own"))

    def short(most: int) -> Callable[[Column], Column]:
        return lambda x: (F.length(x["_own"]) <= most) | (F.lit(False) if carried is None else carried)

    found = []
    for n, most in longest.items():
        places = F.regexp_extract_all(padded, F.lit(gram_pattern(n, beside, heads[n] if heads else None)), F.lit(1))
        found.append(F.filter(F.transform(F.array_distinct(places), cored), short(most)))
    return F.concat(*found) if found else F.array().cast("array<struct<_gram:string,_own:string>>")


def spellings(core: Column, before: Column, after: Column) -> Column:
    """The forms that a place of ``core`` may match, but for those that :func:`is_exact`: with the ends of what stands before and the beginnings of what stands after.

    One character before and after stays out: what stands there may not be a letter or digit.
    """
    def single(x: Column, end: str) -> Column:
        return (F.length(x) == 0) | (~x.rlike(end) & (core_of(x) == x))

    def cuts(x: Column, cut: Callable[[Column], Column], end: str) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(x)), cut)
        return F.when(F.length(x) == 1, F.array(F.lit(""))).otherwise(F.filter(every, lambda y: single(y, end)))

    leads = cuts(before, lambda i: F.substr(before, i + 1), f"^{FAST_GLUE}")
    trails = cuts(after, lambda i: F.left(after, F.length(after) - i), f"{FAST_GLUE}$")
    every = F.flatten(F.transform(leads, lambda x: F.transform(trails, lambda y: F.concat(x, core, y))))
    return F.when((F.length(before) == 1) & (F.length(after) == 1), F.array(core)).otherwise(every)


def with_text(vocab: DataFrame, asked: DataFrame, spelt: Column, how: str = "inner") -> DataFrame:
    """The rows ``asked`` for by a hash, each with a row of a vocabulary whose ``spelt`` form has that hash.

    Each row on either side crosses one exchange, once. What shares no more than the hash is told apart later.
    """
    # most names are spelt like their form, and travel once
    named = F.when(~F.col("canonical").eqNullSafe(F.col("surface")), F.col("canonical"))
    keyed = vocab.select(
        *[c for c in VOCAB if c != "canonical"], named.alias("_named"), F.col("canonical").isNull().alias("_nameless"), F.xxhash64(spelt).alias("_hash"),
    )
    # what a text explodes to is far larger than its files, so their size is no reason to broadcast it
    met = asked.join(keyed.hint("merge"), "_hash", how)
    canonical = F.when(~F.col("_nameless"), F.coalesce("_named", "surface")).alias("canonical")
    return met.select(*[canonical if c == "canonical" else c for c in VOCAB], F.col("_nameless").isNotNull().alias("_met"), *asked.columns)


def exact_cores(vocab: DataFrame) -> list[int] | None:
    """The hashes of the cores of forms that :func:`is_exact`; None where there are too many to list."""
    surface = F.lower("surface")
    cores = vocab.filter(is_exact(surface)).select(F.xxhash64(core_of(F.regexp_extract(surface, INNER, 1))).alias("hash"))
    rows = cores.distinct().limit(EXACT_LISTED + 1).collect()
    return [row["hash"] for row in rows] if len(rows) <= EXACT_LISTED else None


def match_many(cut: DataFrame, keys: Sequence[str], vocab: DataFrame, carry: bool) -> tuple[DataFrame, Column]:
    """The n-grams of ``cut`` with the forms of a large vocabulary that stand there, and what else must hold.

    A core may have very many forms that differ in what they ask around it. So n-grams ask for forms as they are
    spelt, and only for the few that :func:`is_exact` by the core alone; n-grams of carriers ask by the core alone.
    """
    before = F.regexp_extract("_gram", "^[^a-z0-9]+", 0)
    after = F.regexp_extract("_gram", "[^a-z0-9]+$", 0)
    inner = F.regexp_extract("_gram", INNER, 1)
    told = cut.select("*", before.alias("_b"), after.alias("_a"), inner.alias("_i"))
    bare = F.concat(F.lit(EDGE), "_own")
    plain = (F.length("_b") == 1) & (F.length("_a") == 1) & (F.col("_i") == F.col("_own"))
    if carry:
        # rows without a core, such as carriers, find no partner; keys of their own keep them from meeting in one task
        told = told.select("*", F.coalesce(bare, F.concat(F.lit(EDGE * 2), F.xxhash64(*keys).cast("string"))).alias("_key"), F.lit(True).alias("_bare"))
    else:
        spelt = F.transform(spellings(F.col("_own"), F.col("_b"), F.col("_a")), lambda x: F.struct(x.alias("_key"), F.lit(False).alias("_bare")))
        # what an exact form matches is never plain
        listed = exact_cores(vocab)
        other = F.lit(False) if listed is None else ~F.xxhash64("_own").isin(listed) if listed else F.lit(True)
        both = F.when(plain | other, spelt).otherwise(F.concat(spelt, F.array(F.struct(bare.alias("_key"), F.lit(True).alias("_bare")))))
        told = told.select("*", F.explode(both).alias("_asked")).select("*", "_asked._key", "_asked._bare")
    asked = told.select(
        *keys, "_carry", "_share", "_bare", F.xxhash64("_key").alias("_hash"), F.when(F.col("_own").isNotNull(), F.hash("_key")).alias("_check"),
        # the usual blank and what a core says anyway do not travel
        F.when(F.col("_bare") & (F.col("_b") != " "), F.col("_b")).alias("_before"),
        F.when(F.col("_bare") & (F.col("_a") != " "), F.col("_a")).alias("_after"),
        F.when(F.col("_bare") & (F.col("_i") != F.col("_own")), F.col("_i")).alias("_raw"),
    )
    surface = F.lower("surface")
    bared = F.concat(F.lit(EDGE), core_of(F.regexp_extract(surface, INNER, 1)))
    spelt = bared if carry else F.when(is_exact(surface), bared).otherwise(surface)
    also = ["_met", "_carry", "_share", "_bare", "_check", "_before", "_after", "_raw"]
    joined = forms(with_text(vocab, asked, spelt, "left" if carry else "inner"), *keys, *also)
    joined = joined.withColumn("term_ord", F.when(F.col("_met"), F.col("term_ord")))
    as_spelt = F.lit(False) if carry else F.col("_exact").isNull()
    same = (F.col("_check") == F.hash(spelt)) & (F.col("_bare") != as_spelt)
    return joined, same


def match_grams(
    units: DataFrame, keys: Sequence[str], body: str, vocab: DataFrame, columns: Sequence[str], carry: Column | None = None,
) -> DataFrame:
    """``keys`` plus a row for every surface form found in ``body``, from a vocabulary table of any size.

    Rows for which ``carry`` holds pass through once with NULL terms, also where nothing matches.
    """
    longest, beside, n_forms = shape(vocab)
    carried = F.lit(False) if carry is None else carry
    how = "inner" if carry is None else "left"
    found_grams = grams(F.col(body), longest, beside, heads_by_runs(vocab, n_forms), carry)
    share = F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int")
    cut = units.select(*keys, carried.alias("_carry"), share.alias("_share"), F.explode_outer(found_grams).alias("_found"))
    cut = cut.select(*keys, "_carry", "_share", "_found._gram", "_found._own")
    before = F.regexp_extract("_gram", "^[^a-z0-9]+", 0)
    after = F.regexp_extract("_gram", "[^a-z0-9]+$", 0)
    if n_forms > MANY_FORMS:
        joined, same = match_many(cut, keys, vocab, carry is not None)
        before, after = F.coalesce("_before", F.lit(" ")), F.coalesce("_after", F.lit(" "))
        gram, spelt = F.concat(before, F.coalesce("_raw", "_core"), after), ~F.col("_bare")
    else:
        side = forms(vocab).select("*", F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("_part"))
        # all n-grams of the texts are far larger than the files of the texts, too
        side = side.hint("merge") if n_forms > TREE_WORDS else side
        alone = F.concat(F.lit(EDGE), F.xxhash64(*keys).cast("string"))
        keyed = cut.select(*keys, "_carry", "_gram", F.coalesce("_own", alone).alias("_key"), "_share")
        joined = keyed.join(side, (F.col("_key") == F.col("_core")) & (F.col("_share") == F.col("_part")), how)
        gram, same, spelt = F.col("_gram"), F.lit(True), F.lit(False)
    fits = (
        before.endswith(F.col("_lead")) & (F.length(before) > F.length("_lead"))
        & after.startswith(F.col("_trail")) & (F.length(after) > F.length("_trail"))
    )
    # where less stands beside the runs than was looked for, a letter or digit is next to it
    alike = F.rlike(F.concat(F.lit("x"), gram, F.lit("x")), "_exact")
    found = same & F.when(F.col("_exact").isNotNull(), alike).otherwise(spelt | fits)
    return joined.filter(found | F.col("_carry")).select(*keys, *columns)
