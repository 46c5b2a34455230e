"""Line and section structure of a document.

The structure is worked out inside each row with array functions: a document's text
never has to be shuffled or sorted to find out which section a line stands in. The
cost is linear in the number of lines.

Functions named ``with_*`` add an array column; ``lines`` and ``section_texts`` are
the table forms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import SPACE_CLASS, SPACES, escape, let, split_lines, strip, word_count

# Section headings in order of precedence.
SECTION_ALIASES = {
    "summary": ["summary", "professional summary", "profile", "about me", "about",
                "objective", "career objective"],
    "skills": ["skills", "technical skills", "technologies", "tech stack",
               "technical proficiencies", "core competencies", "skills & interests",
               "skills and interests", "tools"],
    "projects": ["projects", "personal projects", "academic projects", "key projects",
                 "selected projects", "technical projects", "side projects",
                 "notable projects"],
    "experience": ["experience", "work experience", "professional experience",
                   "internship", "internships", "internship experience", "employment",
                   "work history", "relevant experience"],
    "education": ["education", "academics", "academic background",
                  "educational background"],
    "achievements": ["achievements", "awards", "honors", "honours", "certifications",
                     "publications"],
}

# Evidence source of each section; any other section is "unknown".
SECTION_SOURCE = {
    "summary": "summary",
    "skills": "skills",
    "projects": "project",
    "experience": "experience",
    "education": "unknown",
    "achievements": "unknown",
    "other": "unknown",
}

FIRST_SECTION = "summary"
HEADING_CHARS = 60
HEADING_WORDS = 3
HEADING_TRIM = "•-–—*#: "
INLINE_HEADING = rf"^([A-Za-z][A-Za-z &/+\-]{{1,40}}?)[{SPACE_CLASS}]*:[{SPACE_CLASS}]*(.+)$"

Aliases = Mapping[str, Sequence[str]]


def normal_heading(line: Column) -> Column:
    """A heading in comparable form: lower case, no bullets or colons, single spaces."""
    bare = F.btrim(F.lower(strip(line)), F.lit(HEADING_TRIM))
    return F.regexp_replace(bare, SPACES, " ")


def heading_section(line: Column, aliases: Aliases = SECTION_ALIASES) -> Column:
    """The section a heading-like line opens, or NULL."""
    def of(heading: Column) -> Column:
        return F.coalesce(*[
            F.when(heading.rlike("^(?:" + "|".join(map(escape, names)) + ")(?:s?$| )"), F.lit(section))
            for section, names in aliases.items() if names
        ])

    def of_stripped(text: Column) -> Column:
        short = F.length(text).between(1, HEADING_CHARS)
        prose = text.endswith(".") & (word_count(text) > HEADING_WORDS)
        return F.when(short & ~prose, let(normal_heading(text), of))

    return let(strip(line), of_stripped)


def inline_heading(line: Column) -> Column:
    """The part before the colon of a ``Heading: content`` line, else ''."""
    return F.regexp_extract(strip(line), INLINE_HEADING, 1)


def inline_content(line: Column) -> Column:
    return strip(F.regexp_extract(strip(line), INLINE_HEADING, 2))


def _heading_candidate(aliases: Aliases) -> str:
    """Every line that opens a section starts with one of the aliases."""
    names = sorted(chain.from_iterable(aliases.values()))
    spaced = [escape(name).replace(" ", f"[{SPACE_CLASS}]+") for name in names]
    return f"(?i)^[{SPACE_CLASS}{escape(HEADING_TRIM)}]*(?:{'|'.join(spaced)})"


def _mark(line: Column, position: Column, aliases: Aliases) -> Column:
    """``(position, section, rest)`` when the line opens a section, else NULL."""
    found = let(
        heading_section(inline_heading(line), aliases),
        lambda inline: F.struct(
            position.alias("position"),
            F.coalesce(inline, heading_section(line, aliases)).alias("section"),
            F.when(inline.isNotNull(), inline_content(line)).alias("rest"),
        ),
    )
    return F.when(
        line.rlike(_heading_candidate(aliases)),
        let(found, lambda mark: F.when(mark["section"].isNotNull(), mark)),
    )


def with_line_sections(
    docs: DataFrame, aliases: Aliases = SECTION_ALIASES, text: str = "text"
) -> DataFrame:
    """Add ``line_sections``: ``array<struct<line_no, section, line>>`` in document order.

    Heading lines are dropped, the content of an inline heading keeps its line number,
    and lines before the first heading belong to the summary.
    """
    before_first = F.struct(
        F.lit(-1).alias("position"),
        F.lit(FIRST_SECTION).alias("section"),
        F.lit(None).cast("string").alias("rest"),
    )
    keep = docs.columns
    split = docs.withColumn("_lines", split_lines(F.coalesce(F.col(text), F.lit(""))))
    marked = split.withColumn(
        "_marks",
        F.concat(
            F.array(before_first),
            F.filter(
                F.transform("_lines", lambda line, i: _mark(line, i, aliases)),
                lambda mark: mark.isNotNull(),
            ),
        ),
    )
    segments = marked.withColumn(
        "_segments",
        F.transform(
            "_marks",
            lambda mark, k: F.struct(
                mark["section"].alias("section"),
                mark["position"].alias("position"),
                mark["rest"].alias("rest"),
                F.slice(
                    F.col("_lines"),
                    mark["position"] + 2,
                    F.coalesce(F.get(F.col("_marks"), k + 1)["position"], F.size("_lines"))
                    - mark["position"] - 1,
                ).alias("body"),
            ),
        ),
    )

    def segment_lines(segment: Column) -> Column:
        head = F.struct(
            segment["position"].alias("line_no"),
            segment["section"].alias("section"),
            segment["rest"].alias("line"),
        )
        body = F.transform(
            segment["body"],
            lambda line, j: F.struct(
                (segment["position"] + 1 + j).alias("line_no"),
                segment["section"].alias("section"),
                line.alias("line"),
            ),
        )
        return F.when(F.length(segment["rest"]) > 0, F.concat(F.array(head), body)).otherwise(body)

    return segments.select(
        *keep, F.flatten(F.transform("_segments", segment_lines)).alias("line_sections")
    )


def lines(docs: DataFrame, aliases: Aliases = SECTION_ALIASES) -> DataFrame:
    """``(doc_id, line_no, section, line)``, one row per content line."""
    sectioned = with_line_sections(docs.select("doc_id", "text"), aliases)
    return sectioned.select("doc_id", F.inline_outer("line_sections")).filter("line_no IS NOT NULL")


def text_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` for every line, headings included."""
    return (
        docs.filter(F.length("text") > 0)
        .select("doc_id", F.posexplode_outer(split_lines(F.col("text"))).alias("line_no", "line"))
    )


def section_text(line_sections: Column, section: str) -> Column:
    """The joined lines of one section, stripped; '' when the section is absent."""
    own = F.filter(line_sections, lambda x: x["section"] == section)
    return strip(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))


def section_texts(docs: DataFrame, aliases: Aliases = SECTION_ALIASES) -> DataFrame:
    """``(doc_id, section, section_text)`` for every section a document has text in."""
    sectioned = with_line_sections(docs.select("doc_id", "text"), aliases)
    texts = F.array(*[
        F.struct(
            F.lit(section).alias("section"),
            section_text(F.col("line_sections"), section).alias("section_text"),
        )
        for section in aliases
    ])
    return (
        sectioned.select("doc_id", F.inline_outer(texts)).filter(F.length("section_text") > 0)
    )


def source_of(section: Column, sources: Mapping[str, str] = SECTION_SOURCE) -> Column:
    """Section to evidence source."""
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sources.items()))
    return F.coalesce(F.element_at(F.create_map(*pairs), section), F.lit("unknown"))


def scoring_context(
    docs: DataFrame, limit: int, aliases: Aliases = SECTION_ALIASES
) -> DataFrame:
    """``(doc_id, context)``: projects and experience for an outside judge, else the whole text."""
    sectioned = with_line_sections(docs.select("doc_id", "text"), aliases)
    parts = sectioned.select(
        "doc_id", "text",
        section_text(F.col("line_sections"), "projects").alias("projects"),
        section_text(F.col("line_sections"), "experience").alias("experience"),
    )
    joined = F.concat_ws(
        "\n\n",
        F.when(F.length("projects") > 0, F.concat(F.lit("PROJECTS\n"), "projects")),
        F.when(F.length("experience") > 0, F.concat(F.lit("EXPERIENCE\n"), "experience")),
    )
    context = F.when(F.length(joined) > 0, joined).otherwise(F.coalesce("text", F.lit("")))
    return parts.select("doc_id", F.left(context, F.lit(limit)).alias("context"))


def full_context(docs: DataFrame, limit: int) -> DataFrame:
    """``(doc_id, context)``: the first ``limit`` characters of the text."""
    return docs.select(
        "doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(limit)).alias("context")
    )
