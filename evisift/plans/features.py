"""One pass over the text: everything the gate and the score need, one row per document.

Each document is cut into units (its content lines, its whole text, its projects and
its possible name lines). All units meet the vocabulary in one join, the hits travel to
their document in one exchange, and three aggregations on that same partitioning fold
them. The text itself is never shuffled; the per-document fields ride along with a
carrier unit, so the text is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import is_blank
from evisift.operators.fields import choose_name, with_contact_fields
from evisift.operators.gate import OK, shows_ai, shows_python
from evisift.operators.judgements import PROJECT_TYPE, rough_project
from evisift.operators.matching import match_rows
from evisift.operators.projects import domain_of, domain_rank, with_project_blocks
from evisift.operators.scoring import by_name, source_multiplier, where_label
from evisift.operators.sections import SECTION_ALIASES, source_of, with_line_sections
from evisift.params import ScreenParams
from evisift.vocabulary import Vocabulary

DOC, TEXT, LINE, PROJECT, NAME = "doc", "text", "line", "project", "name"
TERM_ORDER = ("grp_ord", "ord")
PLACE_ORDER = ("part", "line_no", *TERM_ORDER)
UNIT = "struct<kind:string,idx:int,source:string,body:string>"


def _unit(kind: str, idx: Column, source: Column, body: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), idx.cast("int").alias("idx"),
        source.cast("string").alias("source"), body.cast("string").alias("body"),
    )


def units(docs: DataFrame, params: ScreenParams) -> DataFrame:
    """``(doc_id, payload, kind, idx, source, body)``; the carrier unit has kind ``doc``."""
    none = F.lit(None)
    text = F.when(F.col("parse_status") == OK, F.col("text")).otherwise("")
    aliases = SECTION_ALIASES if params.aliases is None else params.aliases
    known = with_contact_fields(docs.withColumn("text", F.coalesce(text, F.lit(""))), aliases)
    parsed = with_project_blocks(with_line_sections(known, aliases), params.limits)
    content = F.filter("line_sections", lambda x: ~is_blank(x["line"]))
    rough = F.transform("blocks", lambda b: F.struct(b["name"].alias("name"), b["description"].alias("description")))
    payload = F.struct(
        "source_file", "filename", "parse_status", "error", "content_hash",
        (F.length("text") > 0).alias("has_text"),
        "email", "username", "name_candidates", "name_fallback", rough.alias("rough"),
    )
    listed = parsed.select(
        "doc_id",
        payload.alias("payload"),
        F.concat(
            F.array(_unit(DOC, F.lit(0), none, none), _unit(TEXT, F.lit(0), none, F.col("text"))),
            F.transform(content, lambda x: _unit(LINE, x["line_no"], source_of(x["section"]), x["line"])),
            F.transform("blocks", lambda b, i: _unit(PROJECT, i, none, b["body"])),
            F.transform("name_candidates", lambda c: _unit(NAME, c["line_no"], none, c["line"])),
        ).cast(f"array<{UNIT}>").alias("units"),
    )
    return listed.select("doc_id", "payload", F.inline_outer("units"))


def unit_hits(docs: DataFrame, vocab: Vocabulary | DataFrame, params: ScreenParams) -> DataFrame:
    """Units that hold a term, plus one carrier row per document, partitioned by document."""
    cut = units(docs, params).withColumn(
        "payload", F.when(F.col("kind") == DOC, F.col("payload"))
    )
    hits = match_rows(
        cut, ["doc_id", "kind", "idx", "source", "payload"], "body", vocab,
        carry=F.col("kind") == DOC,
    )
    return hits.repartition("doc_id")


def features(docs: DataFrame, vocab: Vocabulary | DataFrame, params: ScreenParams) -> DataFrame:
    """One row per document of ``docs(doc_id, source_file, filename, text, parse_status, error, content_hash)``."""
    hits = unit_hits(docs, vocab, params)
    is_line = F.col("kind") == LINE
    line_no = F.when(is_line, F.col("idx")).otherwise(0).cast("long")
    is_python = F.col("grp") == "python"
    scored = F.col("grp") != "ai"
    # orders are flat structs: Spark makes a new ordering for each comparison of a struct within a struct
    ords = [F.col("term_ord")[part].alias(part) for part in TERM_ORDER]

    # 1. one row per document, unit (all lines together) and term
    terms = hits.groupBy(
        "doc_id", "kind", F.when(is_line, 0).otherwise(F.col("idx")).alias("idx"), "canonical"
    ).agg(
        F.first("payload", ignorenulls=True).alias("payload"),
        F.min("term_ord").alias("term_ord"),
        F.max("tier").alias("tier"),
        F.bool_or(shows_python(F.col("grp"))).alias("python"),
        F.bool_or(shows_ai(F.col("tier"), F.col("source"))).alias("ai"),
        F.bool_or(F.col("grp") == "engineering").alias("engineering"),
        F.min(domain_rank(F.col("grp"), F.col("canonical"), F.col("tier"))).alias("domain_rank"),
        F.max(F.when(scored, source_multiplier(F.col("source"), params))).alias("best"),
        F.min(F.when(scored, F.struct((~is_python).alias("part"), line_no.alias("line_no"), *ords))).alias("python_at"),
        F.min(F.when(scored, F.struct(is_python.alias("part"), line_no.alias("line_no"), *ords))).alias("other_at"),
    )

    # 2. one row per document and unit
    name = F.col("canonical")
    told = F.concat(name, F.lit(" ("), where_label(F.col("best"), params), F.lit(")"))
    python_weight = F.when(F.col("best").isNotNull(), by_name(params.python_backend_tenths, name))
    cloud_weight = F.when(F.col("best").isNotNull(), by_name(params.cloud_fullstack_tenths, name))

    def in_order(condition: Column, order: str, parts: Sequence[str], value: Column) -> Column:
        at = [F.col(order)[part].alias(part) for part in parts]
        pairs = F.collect_list(F.when(condition, F.struct(*at, value.alias("value"))))
        return F.sort_array(pairs)["value"]

    folded = terms.groupBy("doc_id", "kind", "idx").agg(
        F.first("payload", ignorenulls=True).alias("payload"),
        in_order(name.isNotNull(), "term_ord", TERM_ORDER, name).alias("names"),
        F.min("domain_rank").alias("domain_rank"),
        F.struct(
            F.bool_or("python").alias("has_python"),
            F.bool_or("ai").alias("has_ai"),
            F.sum(python_weight * F.col("best")).alias("python_sum"),
            F.sum(cloud_weight * F.col("best")).alias("cloud_sum"),
            in_order(python_weight.isNotNull(), "python_at", PLACE_ORDER, told).alias("python_terms"),
            in_order(cloud_weight.isNotNull(), "other_at", PLACE_ORDER, told).alias("cloud_terms"),
            F.sort_array(F.collect_list(F.when(F.col("engineering"), name))).alias("engineering_terms"),
            F.sort_array(F.collect_list(F.when(F.col("tier") == "core", name))).alias("core_terms"),
        ).alias("line"),
    )

    # 3. one row per document
    def of(kind: str, value: Column | str) -> Column:
        return F.when(F.col("kind") == kind, F.col(value) if isinstance(value, str) else value)

    rows = folded.groupBy("doc_id").agg(
        F.first("payload", ignorenulls=True).alias("payload"),
        F.first(of(TEXT, "names"), ignorenulls=True).alias("skills"),
        F.first(of(LINE, "line"), ignorenulls=True).alias("line"),
        F.collect_list(of(NAME, "idx")).alias("rejected_lines"),
        F.map_from_entries(F.collect_list(of(PROJECT, F.struct(
            "idx", F.struct(F.array_sort("names").alias("names"), "domain_rank")
        )))).alias("project_terms"),
    )
    none = F.array().cast("array<string>")
    p, line = F.col("payload"), F.col("line")

    def project(rough: Column, i: Column) -> Column:
        found = F.element_at(F.col("project_terms"), i)
        return rough_project(
            rough["name"], rough["description"],
            F.coalesce(found["names"], none), domain_of(found["domain_rank"]),
        )

    return rows.select(
        "doc_id",
        *[p[c].alias(c) for c in (
            "source_file", "filename", "parse_status", "error", "content_hash", "has_text",
            "email", "username",
        )],
        choose_name(p["name_candidates"], F.col("rejected_lines"), p["name_fallback"]).alias("candidate_name"),
        F.coalesce("skills", none).alias("skills"),
        F.transform(p["rough"], project).cast(f"array<{PROJECT_TYPE}>").alias("projects"),
        F.coalesce(line["has_python"], F.lit(False)).alias("has_python"),
        F.coalesce(line["has_ai"], F.lit(False)).alias("has_ai"),
        *[F.coalesce(line[c], F.lit(0)).cast("long").alias(c) for c in ("python_sum", "cloud_sum")],
        *[F.coalesce(line[c], none).alias(c) for c in (
            "python_terms", "cloud_terms", "engineering_terms", "core_terms"
        )],
    )
