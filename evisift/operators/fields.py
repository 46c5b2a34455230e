"""Contact fields and names, and the profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import (
    SPACE_CLASS,
    any_of,
    file_stem,
    let,
    split_lines,
    squeeze,
    strip,
    title_case,
)
from evisift.operators.matching import match_rows, skills
from evisift.operators.sections import SECTION_ALIASES, Aliases, heading_section
from evisift.vocabulary import Vocabulary

# Fixed values.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
HANDLE = r"(?i)github\.com/([A-Za-z0-9_\-]+)"
PROFILE_URL = "https://github.com/"
RESERVED_HANDLES = ["features", "orgs", "about", "pricing", "marketplace", "topics", "settings"]
ROLE_WORDS = [
    "developer", "engineer", "student", "intern", "internship", "analyst", "designer",
    "manager", "scientist", "architect", "resume", "curriculum", "vitae", "profile",
    "summary", "contact", "email", "phone", "portfolio", "github", "linkedin",
]
NOT_IN_NAME = ["resume", "curriculum", "vitae", "profile", "summary"]
STEM_NOISE = r"(?i)\b(?:resume|cv|final|updated|new|\p{Nd}+|candidate)\b"
PHONE_LINE = (
    rf"^[{SPACE_CLASS}]*([A-Za-z][A-Za-z.'\-]*)[{SPACE_CLASS}]+[+|]?[{SPACE_CLASS}]*\+?\p{{Nd}}"
)
UNKNOWN_NAME = "Unknown Candidate"
NAME_LINES = 15
CONTACT_LINES = 6


def email(text: Column) -> Column:
    """The first e-mail address, or NULL."""
    found = F.regexp_extract(text, EMAIL, 0)
    return F.when(F.contains(text, F.lit("@")), F.nullif(found, F.lit("")))


def handle(text: Column) -> Column:
    """The first profile handle; NULL when absent or a reserved path."""
    first = F.regexp_extract(text, HANDLE, 1)
    return F.when((first != "") & ~F.lower(first).isin(RESERVED_HANDLES), first)


def handle_url(username: Column) -> Column:
    return F.concat(F.lit(PROFILE_URL), username)


def plausible_name(line: Column, aliases: Aliases = SECTION_ALIASES) -> Column:
    """TRUE for a stripped line that could be a person's name, before the vocabulary is asked."""
    lowered = F.lower(line)
    return (
        line.rlike(r"^[A-Za-z][A-Za-z.\-']* +(?:[A-Za-z.\-']+ +){0,2}[A-Za-z.\-']+\z")
        & ~lowered.rlike(any_of(["http", *NOT_IN_NAME]))
        & (line != lowered)
        & heading_section(line, aliases).isNull()
        & ~lowered.rlike(f"(?<![a-z]){any_of(ROLE_WORDS)}(?![a-z])")
    )


def name_candidates(text: Column, aliases: Aliases = SECTION_ALIASES) -> Column:
    """``array<struct<line_no, line>>``: plausible names among the first lines."""
    head = F.slice(split_lines(text), 1, NAME_LINES)
    numbered = F.transform(
        head, lambda line, i: F.struct(i.alias("line_no"), strip(line).alias("line"))
    )
    return F.filter(numbered, lambda x: plausible_name(x["line"], aliases))


def contact_name(text: Column, email: Column) -> Column:
    """A name that stands before a phone number, its surname rebuilt from the e-mail."""
    head = F.slice(split_lines(text), 1, CONTACT_LINES)
    firsts = F.filter(
        F.transform(head, lambda line: F.regexp_extract(line, PHONE_LINE, 1)),
        lambda w: (w != "") & ~F.lower(w).isin(ROLE_WORDS),
    )
    local = F.lower(F.regexp_replace(F.substring_index(email, "@", 1), "[0-9]+", ""))

    def of_first(first: Column) -> Column:
        surname = F.substring(local, F.length(first) + 1, F.length(local))
        has_surname = (
            local.startswith(F.lower(first))
            & (F.length(local) > F.length(first) + 1)
            & surname.rlike("^[a-z]+$")
        )
        return F.when(
            has_surname, F.concat(title_case(first), F.lit(" "), title_case(surname))
        ).otherwise(title_case(first))

    return let(F.get(firsts, F.lit(0)), of_first)


def email_name(email: Column) -> Column:
    """A name from two or more parts of the e-mail's local part, or NULL."""
    parts = F.filter(
        F.split(F.substring_index(email, "@", 1), r"[._\-]+|[0-9]+"), lambda t: F.length(t) >= 2
    )
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, title_case), " "))


def file_name(filename: Column) -> Column:
    """A name from the file stem, with words such as "final" and numbers removed."""
    spaced = F.regexp_replace(file_stem(filename), r"[_\-]+", " ")
    cleaned = squeeze(F.regexp_replace(spaced, STEM_NOISE, ""))
    return F.when(F.length(cleaned) > 0, title_case(cleaned)).otherwise(F.lit(UNKNOWN_NAME))


def choose_name(candidates: Column, rejected_lines: Column, fallback: Column) -> Column:
    """The first candidate whose line holds no vocabulary term, else the fallback."""
    free = F.filter(
        candidates,
        lambda c: ~F.array_contains(F.coalesce(rejected_lines, F.array().cast("array<int>")), c["line_no"]),
    )
    return F.coalesce(F.get(free, F.lit(0))["line"], fallback)


def with_contact_fields(docs: DataFrame, aliases: Aliases = SECTION_ALIASES) -> DataFrame:
    """Add ``email``, ``username``, ``name_candidates`` and ``name_fallback``."""
    found = docs.withColumns({
        "email": email(F.col("text")),
        "username": handle(F.col("text")),
    })
    return found.withColumns({
        "name_candidates": name_candidates(F.col("text"), aliases),
        "name_fallback": F.coalesce(
            contact_name(F.col("text"), F.col("email")),
            email_name(F.col("email")),
            file_name(F.col("filename")),
        ),
    })


def names(docs: DataFrame, vocab: Vocabulary | DataFrame) -> DataFrame:
    """``(doc_id, candidate_name)``."""
    found = with_contact_fields(docs.select("doc_id", "filename", "text")).drop("text")
    units = found.select("doc_id", F.inline_outer("name_candidates"))
    rejected = (
        match_rows(units, ["doc_id", "line_no"], "line", vocab)
        .groupBy("doc_id")
        .agg(F.collect_set("line_no").alias("_rejected"))
    )
    return found.join(rejected, "doc_id", "left").select(
        "doc_id",
        choose_name(F.col("name_candidates"), F.col("_rejected"), F.col("name_fallback")).alias(
            "candidate_name"
        ),
    )


def profiles(docs: DataFrame, vocab: Vocabulary | DataFrame) -> DataFrame:
    """One row per document: name, e-mail, handle, profile address and skills."""
    contact = docs.select(
        "doc_id",
        email(F.col("text")).alias("email"),
        handle(F.col("text")).alias("username"),
    )
    return (
        contact.join(names(docs, vocab), "doc_id", "left")
        .join(skills(docs, vocab), "doc_id", "left")
        .select(
            "doc_id", "candidate_name", "email", "username",
            handle_url(F.col("username")).alias("profile_url"),
            F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        )
    )
