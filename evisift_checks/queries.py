"""The checked queries: each operator on whole tables, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evisift.functions.points import as_points
from evisift.functions.text import SPACE_CLASS, clean, clip_words, quality_hundredths, strip
from evisift.operators import activity as act
from evisift.operators import dedupe, fields, judgements, matching, projects, ranking, scoring, sections
from evisift.operators import gate as gates
from evisift.operators import signals as sig
from evisift.params import ScreenParams
from evisift.plans import report as reports
from evisift.plans import screening
from evisift.plans.features import features
from evisift.session import shared_folder, written
from evisift.sources import files, landed, ordered, store
from evisift.vocabulary import Vocabulary
from evisift_checks import corpus
from evisift_checks import oracle as o

PARAMS = ScreenParams(as_of=datetime(2024, 2, 1))
STANDARD, PLAIN = o.STANDARD, o.PLAIN
PATHS_KEPT = 200
TOP = 25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def checked(name: str, sql: str | None, *needs: str):
    """Register a query under ``name``, with its SQL twin built on the named CTEs."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = o.query(sql, *needs)
        return fn
    return register


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------
_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _tables[key]


def composed(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A composed input, its statement applied to the given tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    for name in ("events", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(corpus.spark_sql(statement))


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def applications(spark, sf_dir) -> DataFrame:
    """The composed applications with cleaned text, as a documents table."""
    raw = composed(spark, sf_dir, corpus.APPLICATIONS)
    cleaned = raw.withColumns({"content_hash": F.sha2("text", 256), "text": clean(F.col("text"))})
    empty = F.length("text") == 0
    return cleaned.withColumns({
        "parse_status": F.when(empty, "empty").otherwise("ok"),
        "error": F.when(empty, files.EMPTY_ERROR),
    })


def app_lines(spark, sf_dir) -> DataFrame:
    return sections.lines(applications(spark, sf_dir))


def app_evidence(spark, sf_dir) -> DataFrame:
    return matching.evidence(app_lines(spark, sf_dir), STANDARD)


def activity_tables(spark, sf_dir) -> screening.ActivityTables:
    return screening.ActivityTables(
        composed(spark, sf_dir, corpus.ACTIVITY_PROFILES),
        composed(spark, sf_dir, corpus.ACTIVITY_EVENTS),
        composed(spark, sf_dir, corpus.ACTIVITY_REPOS),
    )


_runs: dict[tuple[str, str], screening.Report] = {}


def run(spark: SparkSession, sf_dir: str) -> screening.Report:
    """One full run; its written tables serve every query about its outputs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = screening.screen(
            applications(spark, sf_dir), STANDARD, PARAMS, activity_tables(spark, sf_dir),
            composed(spark, sf_dir, corpus.RESPONSES),
        )
    return _runs[key]


def results(spark, sf_dir) -> DataFrame:
    return run(spark, sf_dir).results


def joined(array: str | Column, separator: str = " | ") -> Column:
    return F.array_join(array, separator)


# ---------------------------------------------------------------------------
# Sources and duplicates
# ---------------------------------------------------------------------------
@checked("text_clean", "SELECT doc_id, text AS cleaned FROM clean_files", "clean_files")
def text_clean(spark, sf_dir):
    raw = composed(spark, sf_dir, corpus.RAW_FILES)
    return raw.select("doc_id", clean(F.col("raw_text")).alias("cleaned"))


@checked("parse_status", f"""
    SELECT doc_id, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN text = '' THEN 'empty' ELSE 'ok' END AS parse_status,
           CASE WHEN failed IS NOT NULL THEN failed WHEN text = '' THEN '{files.EMPTY_ERROR}' END AS error,
           CAST(CASE WHEN failed IS NULL THEN length(text) ELSE 0 END AS INTEGER) AS chars
    FROM (SELECT *, CASE WHEN extension NOT IN ({o.quoted(files.SUPPORTED)}) THEN concat('unsupported extension: ', extension)
                         ELSE error END AS failed FROM clean_files) AS f""", "clean_files")
def parse_status(spark, sf_dir):
    return files.with_status(composed(spark, sf_dir, corpus.RAW_FILES)).select(
        "doc_id", "parse_status", "error", F.length("text").alias("chars")
    )


@checked("decoded_text", "SELECT doc_id, text AS decoded FROM documents")
def decoded_text(spark, sf_dir):
    """Every other text that Latin-1 can write arrives in Latin-1, the rest in UTF-8."""
    latin = (F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[^\x00-\xff]")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", files.decoded(content).alias("decoded"))


_QUALITY = f"""CASE WHEN NOT regexp_matches(lower(text), '[a-z][a-z]') THEN -100 ELSE
    200 * len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({o.quoted(o.COMMON_WORDS)})))
    + 5 * {o.words('text')} - 500 * len(list_filter(regexp_extract_all(text, '[^{o.SPACE_CLASS}]+'), lambda t: length(t) > 20)) END"""


@checked("text_quality", f"SELECT doc_id, {_QUALITY} / 100.0 AS quality FROM documents")
def text_quality(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", as_points(quality_hundredths(F.col("text"))).alias("quality")
    )


o.cte("extractions", corpus.duckdb_sql(corpus.EXTRACTIONS))


@checked("best_extraction", f"""
    SELECT doc_id, CASE WHEN t1 IS NULL AND t2 IS NULL THEN NULL WHEN t1 IS NULL OR (t2 IS NOT NULL AND q2 * 100 > q1 * 115) THEN 'plain' ELSE 'layout' END AS extractor,
           sha256(CASE WHEN t1 IS NULL OR (t2 IS NOT NULL AND q2 * 100 > q1 * 115) THEN t2 ELSE t1 END) AS text_hash,
           CASE WHEN t1 IS NULL AND t2 IS NULL THEN concat('layout: ', coalesce(e1, 'no text'), '; plain: no text') END AS error
    FROM (SELECT doc_id, max(text) FILTER (pri = 1) AS t1, max(text) FILTER (pri = 2) AS t2, max(q) FILTER (pri = 1) AS q1,
                 max(q) FILTER (pri = 2) AS q2, max(error) FILTER (pri = 1) AS e1
          FROM (SELECT doc_id, pri, error, CASE WHEN {o.trim('text')} <> '' THEN text END AS text, {_QUALITY} AS q FROM extractions) AS x
          GROUP BY doc_id) AS g""", "extractions")
def best_extraction(spark, sf_dir):
    best = files.best_extractions(composed(spark, sf_dir, corpus.EXTRACTIONS))
    return best.select("doc_id", "extractor", F.sha2("text", 256).alias("text_hash"), "error")


@checked("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@checked("exact_duplicates", """
    SELECT doc_id, CASE WHEN place > 1 THEN 'duplicate' ELSE 'ok' END AS parse_status,
           CASE WHEN place > 1 THEN concat('duplicate of ', first_name) END AS error
    FROM (SELECT doc_id, row_number() OVER w AS place, first_value(concat(doc_id, '.txt')) OVER w AS first_name
          FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY source, concat(doc_id, '.txt'))) AS d""")
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("drop/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source_file"),
        F.concat("doc_id", F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit("ok").alias("parse_status"), F.lit(None).cast("string").alias("error"),
    )
    return dedupe.mark_duplicates(docs, PARAMS.hot_rows).select("doc_id", "parse_status", "error")


@checked("path_limit", f"""
    SELECT doc_id, source_file FROM apps_raw ORDER BY string_split(source_file, '/') LIMIT {PATHS_KEPT}""", "apps_raw")
def path_limit(spark, sf_dir):
    apps = composed(spark, sf_dir, corpus.APPLICATIONS)
    return ranking.first_in_path_order(apps, PATHS_KEPT).select("doc_id", "source_file")


@checked("pending_requests", """
    SELECT DISTINCT username FROM contacts WHERE username IS NOT NULL
      AND username NOT IN (SELECT username FROM profiles WHERE http_status = 200)""", "contacts", "profiles")
def pending_requests(spark, sf_dir):
    wanted = applications(spark, sf_dir).select(fields.handle(F.col("text")).alias("username")).filter("username IS NOT NULL")
    landed = composed(spark, sf_dir, corpus.ACTIVITY_PROFILES).withColumn("key", dedupe.payload_key("username"))
    done = dedupe.storable(landed, F.col("http_status") == 200)
    return dedupe.pending(wanted, done, "username").select("username")


@checked("rerun_requests", """
    SELECT DISTINCT c.username, p.public_repos, p.username IS NULL AS pending_again
    FROM contacts AS c LEFT JOIN (SELECT * FROM profiles WHERE http_status = 200) AS p USING (username)
    WHERE c.username IS NOT NULL""", "contacts", "profiles")
def rerun_requests(spark, sf_dir):
    """Two runs on one store: the second asks only for what the first did not get."""
    handles = applications(spark, sf_dir).select(fields.handle(F.col("text")).alias("username")).filter("username IS NOT NULL")
    wanted = written(handles.distinct().withColumn("key", dedupe.payload_key("username")), "wanted")
    kept = store.ResultStore(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}", "public_repos int")
    answers = composed(spark, sf_dir, corpus.ACTIVITY_PROFILES)
    first = kept.missing(wanted).join(answers, "username")
    kept.append(dedupe.storable(first, F.col("http_status") == 200))
    again = kept.missing(wanted).select("key", F.lit(True).alias("pending_again"))
    found = wanted.join(kept.results(wanted), "key", "left").join(again, "key", "left")
    return found.select("username", "public_repos", F.coalesce("pending_again", F.lit(False)).alias("pending_again"))


# ---------------------------------------------------------------------------
# Lines and sections
# ---------------------------------------------------------------------------
@checked("text_lines", """
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, l[line_no + 1] AS line
    FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l
          FROM documents WHERE text <> '') AS d, unnest(range(len(l))) AS t(line_no)""")
def text_lines(spark, sf_dir):
    return sections.text_lines(documents(spark, sf_dir))


@checked("heading_normal", "SELECT doc_id, line_no, norm AS heading FROM probes WHERE which = 'own'", "probes")
def heading_normal(spark, sf_dir):
    lines = sections.text_lines(applications(spark, sf_dir))
    return lines.select("doc_id", "line_no", sections.normal_heading(F.col("line")).alias("heading"))


@checked("heading_match", "SELECT doc_id, line_no, own_section AS section FROM marks", "marks")
def heading_match(spark, sf_dir):
    lines = sections.text_lines(applications(spark, sf_dir))
    return lines.select("doc_id", "line_no", sections.heading_section(F.col("line")).alias("section"))


@checked("inline_heading", "SELECT doc_id, line_no, inline_section AS section, rest FROM marks WHERE inline_section IS NOT NULL", "marks")
def inline_heading(spark, sf_dir):
    lines = sections.text_lines(applications(spark, sf_dir))
    return lines.select(
        "doc_id", "line_no",
        sections.heading_section(sections.inline_heading(F.col("line"))).alias("section"),
        sections.inline_content(F.col("line")).alias("rest"),
    ).filter("section IS NOT NULL")


@checked("section_lines", "SELECT doc_id, line_no, section, line FROM assigned", "assigned")
def section_lines(spark, sf_dir):
    return app_lines(spark, sf_dir)


@checked("section_texts", "SELECT doc_id, section, section_text FROM section_text WHERE section_text <> ''", "section_text")
def section_texts(spark, sf_dir):
    return sections.section_texts(applications(spark, sf_dir))


@checked("section_sources", """
    SELECT source, section, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM assigned JOIN sources USING (section)
    GROUP BY ALL""", "assigned", "sources")
def section_sources(spark, sf_dir):
    lines = app_lines(spark, sf_dir).withColumn("source", sections.source_of(F.col("section")))
    per_doc = lines.groupBy("source", "section", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("source", "section").agg(
        F.sum("n").alias("n_lines"), F.count("*").alias("n_docs")
    )


@checked("title_lines", f"SELECT doc_id, line_no, {o.IS_TITLE} AS is_title FROM app_lines", "app_lines")
def title_lines(spark, sf_dir):
    lines = sections.text_lines(applications(spark, sf_dir))
    return lines.select("doc_id", "line_no", projects.is_title(F.col("line")).alias("is_title"))


@checked("scoring_context", f"""
    SELECT a.doc_id, left(CASE WHEN joined <> '' THEN joined ELSE a.text END, {PARAMS.limits.scoring_context}) AS context
    FROM apps AS a JOIN (
      SELECT d.doc_id, concat_ws(chr(10) || chr(10),
               'PROJECTS' || chr(10) || nullif(max(CASE WHEN section = 'projects' THEN section_text END), ''),
               'EXPERIENCE' || chr(10) || nullif(max(CASE WHEN section = 'experience' THEN section_text END), '')) AS joined
      FROM apps AS d LEFT JOIN section_text AS s USING (doc_id) GROUP BY d.doc_id) AS c USING (doc_id)""", "apps", "section_text")
def scoring_context(spark, sf_dir):
    return sections.scoring_context(applications(spark, sf_dir), PARAMS.limits.scoring_context)


@checked("full_context", f"SELECT doc_id, left(text, {PARAMS.limits.full_context}) AS context FROM documents")
def full_context(spark, sf_dir):
    return sections.full_context(documents(spark, sf_dir), PARAMS.limits.full_context)


# ---------------------------------------------------------------------------
# Terms
# ---------------------------------------------------------------------------
@checked("phrase_match", f"""
    SELECT d.doc_id, v.canonical, count(DISTINCT v.surface) AS surfaces FROM documents AS d JOIN plain_vocab AS v ON {o.found('d.text')}
    GROUP BY ALL""", "plain_vocab")
def phrase_match(spark, sf_dir):
    hits = matching.match_rows(documents(spark, sf_dir), ["doc_id"], "text", PLAIN)
    return hits.groupBy("doc_id", "canonical").agg(F.countDistinct("surface").alias("surfaces"))


@checked("terms_in_text", f"""
    SELECT DISTINCT d.doc_id, v.grp, v.canonical FROM documents AS d JOIN plain_vocab AS v ON {o.found('d.text')}""", "plain_vocab")
def terms_in_text(spark, sf_dir):
    vocab = PLAIN.table(spark)  # a vocabulary table works like the object
    return matching.terms_in_text(documents(spark, sf_dir), vocab).select("doc_id", "grp", "canonical")


@checked("terms_in_pages", f"""
    SELECT DISTINCT d.page_id, v.canonical FROM pages AS d JOIN plain_vocab AS v ON {o.found('d.html')}""", "plain_vocab")
def terms_in_pages(spark, sf_dir):
    return matching.terms_in_text(table(spark, sf_dir, "pages"), PLAIN, "page_id", "html").select("page_id", "canonical")


def phrases_of_documents(spark, sf_dir) -> DataFrame:
    """A vocabulary of every two neighbouring words of the given documents: it grows with them."""
    words = F.filter(F.split(F.lower("text"), f"[{SPACE_CLASS}]+"), lambda w: F.length(w) > 0)
    listed = documents(spark, sf_dir).select(words.alias("words")).filter(F.size("words") > 1)
    pairs = listed.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.slice("words", i, 2))
    )).alias("surface"))
    known = written(pairs.filter(F.col("surface").rlike("[a-z0-9]")).distinct(), "phrases")
    return known.select(
        F.lit("given").alias("grp"), F.lit(0).alias("grp_ord"), F.col("surface").alias("canonical"),
        F.lit(0).alias("ord"), "surface", F.lit(None).cast("string").alias("tier"),
    )


_PAIR_FORMS = rf"""
    WITH pairs AS (
      SELECT DISTINCT concat(words[i], ' ', words[i + 1]) AS form FROM (
        SELECT words, unnest(range(1, len(words))) AS i FROM (
          SELECT list_filter(regexp_split_to_array(lower(text), '[{SPACE_CLASS}]+'), lambda w: length(w) > 0) AS words FROM documents))),
    forms AS (
      SELECT form, regexp_extract_all(form, '[a-z0-9]+') AS runs,
        concat('(^|[^a-z0-9])', replace(regexp_replace(form, '([!-/:-@\[-^`{{-~])', '\\\1', 'g'), ' ', '[{SPACE_CLASS}\-_]+'), '([^a-z0-9]|$)') AS pattern
      FROM pairs WHERE regexp_matches(form, '[a-z0-9]')),
    turns AS (SELECT conv_id, turn, lower(text) AS body, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS heads FROM conversations),
    met AS (SELECT conv_id, turn, body, unnest(heads) AS head FROM turns)"""


@checked("terms_of_any_size", _PAIR_FORMS + """
    SELECT DISTINCT met.conv_id, met.turn, forms.form FROM met JOIN forms ON met.head = forms.runs[1]
    WHERE contains(met.body, forms.runs[-1]) AND regexp_matches(met.body, forms.pattern)""")
def terms_of_any_size(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = matching.match_rows(turns, ["conv_id", "turn"], "text", phrases_of_documents(spark, sf_dir))
    return found.select("conv_id", "turn", F.col("canonical").alias("form")).distinct()


@checked("line_evidence", "SELECT doc_id, evidence_group, term, source, context, line_no FROM evidence", "evidence")
def line_evidence(spark, sf_dir):
    return app_evidence(spark, sf_dir).drop("term_ord")


@checked("evidence_groups", """
    SELECT evidence_group, source, term, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM evidence GROUP BY ALL""", "evidence")
def evidence_groups(spark, sf_dir):
    per_doc = app_evidence(spark, sf_dir).groupBy("evidence_group", "source", "term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("evidence_group", "source", "term").agg(
        F.sum("n").alias("mentions"), F.count("*").alias("docs")
    )


@checked("all_skills", "SELECT doc_id, array_to_string(skills, ' | ') AS skills FROM app_skills", "app_skills")
def all_skills(spark, sf_dir):
    return matching.skills(applications(spark, sf_dir), STANDARD).select("doc_id", joined("skills").alias("skills"))


@checked("evidence_names", """
    SELECT doc_id, string_agg(term, ' | ' ORDER BY place) AS names FROM (
      SELECT doc_id, term, min(CAST(line_no AS BIGINT) * 10000000 + term_ord) AS place FROM evidence GROUP BY ALL) AS e
    GROUP BY doc_id""", "evidence")
def evidence_names(spark, sf_dir):
    return matching.term_names(app_evidence(spark, sf_dir)).select("doc_id", joined("names").alias("names"))


@checked("skill_union", """
    SELECT doc_id, array_to_string(list_concat(skills, CASE WHEN list_contains(skills, 'Python') THEN ['Rust'] ELSE ['Python', 'Rust'] END), ' | ') AS skills
    FROM app_skills""", "app_skills")
def skill_union(spark, sf_dir):
    given = F.array(F.lit(" Python"), F.lit("Rust "), F.lit("Rust"))
    union = F.array_distinct(F.concat("skills", F.transform(given, strip)))
    return matching.skills(applications(spark, sf_dir), STANDARD).select("doc_id", joined(union).alias("skills"))


@checked("tier_overlap", """
    SELECT doc_id, bool_or(coalesce(tier = 'core', false)) AS any_core, bool_or(coalesce(tier = 'general', false)) AS any_general
    FROM text_hits GROUP BY doc_id""", "text_hits")
def tier_overlap(spark, sf_dir):
    hits = matching.terms_in_text(applications(spark, sf_dir), STANDARD)
    names = hits.groupBy("doc_id").agg(F.collect_set("canonical").alias("names"))
    return names.select(
        "doc_id",
        F.arrays_overlap("names", F.lit(STANDARD.names("ai", "core"))).alias("any_core"),
        F.arrays_overlap("names", F.lit(STANDARD.names("ai", "general"))).alias("any_general"),
    )


# ---------------------------------------------------------------------------
# Fields
# ---------------------------------------------------------------------------
@checked("first_email", f"SELECT doc_id, {o.EMAIL_SQL} AS email FROM documents")
def first_email(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", fields.email(F.col("text")).alias("email"))


@checked("profile_handle", f"SELECT doc_id, username, concat('{fields.PROFILE_URL}', username) AS url FROM contacts WHERE username IS NOT NULL", "contacts")
def profile_handle(spark, sf_dir):
    found = applications(spark, sf_dir).select("doc_id", fields.handle(F.col("text")).alias("username"))
    return found.filter("username IS NOT NULL").withColumn("url", fields.handle_url(F.col("username")))


@checked("real_handles", f"""
    SELECT handle, lower(handle) NOT IN ({o.quoted(act.NOT_A_HANDLE)}) AS usable, count(*) AS n
    FROM (SELECT CASE n_chars % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE source END AS handle FROM documents) AS h
    GROUP BY ALL""")
def real_handles(spark, sf_dir):
    handle = F.expr("CASE n_chars % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE source END")
    docs = table(spark, sf_dir, "documents").select(handle.alias("handle"))
    return docs.groupBy("handle", act.is_handle(F.col("handle")).alias("usable")).agg(F.count("*").alias("n"))


@checked("candidate_names", "SELECT doc_id, candidate_name FROM app_names", "app_names")
def candidate_names(spark, sf_dir):
    return fields.names(applications(spark, sf_dir), STANDARD)


@checked("profiles", f"""
    SELECT c.doc_id, n.candidate_name, c.email, c.username, concat('{fields.PROFILE_URL}', c.username) AS profile_url,
           coalesce(array_to_string(s.skills, ' | '), '') AS skills
    FROM (SELECT doc_id, email, username FROM contacts) AS c JOIN app_names AS n USING (doc_id) LEFT JOIN app_skills AS s USING (doc_id)""".replace(
    "concat('https://github.com/', c.username)", "'https://github.com/' || c.username"), "contacts", "app_names", "app_skills")
def profiles(spark, sf_dir):
    return fields.profiles(applications(spark, sf_dir), STANDARD).withColumn("skills", joined("skills"))


# ---------------------------------------------------------------------------
# Projects
# ---------------------------------------------------------------------------
def app_features(spark, sf_dir) -> DataFrame:
    return features(applications(spark, sf_dir), STANDARD, PARAMS)


def graded_projects(spark, sf_dir) -> DataFrame:
    graded = projects.with_graded_projects(app_features(spark, sf_dir), STANDARD, PARAMS.penalties)
    return graded.select("doc_id", F.inline_outer("graded")).filter("name IS NOT NULL")


@checked("project_split", """
    SELECT doc_id, project_no, name, description, array_to_string(technologies, ' | ') AS technologies, domain FROM app_projects""",
    "app_projects")
def project_split(spark, sf_dir):
    found = projects.projects(applications(spark, sf_dir), STANDARD, PARAMS.limits)
    return found.withColumn("technologies", joined("technologies"))


@checked("project_domains", "SELECT domain, count(*) AS n, count(DISTINCT doc_id) AS docs FROM app_projects GROUP BY domain", "app_projects")
def project_domains(spark, sf_dir):
    per_doc = projects.projects(applications(spark, sf_dir), STANDARD).groupBy("domain", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("domain").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@checked("ai_projects", """
    SELECT doc_id, project_no, name FROM app_projects WHERE domain IN ('ai_agentic', 'ai_general')""", "app_projects")
def ai_projects(spark, sf_dir):
    found = projects.projects(applications(spark, sf_dir), STANDARD)
    return found.filter(F.col("domain").isin(projects.AI_DOMAINS)).select("doc_id", "project_no", "name")


_SIGNALS = ", ".join(o.SIGNAL_NAMES)


@checked("project_signals", f"SELECT doc_id, project_no, {_SIGNALS}, signal_count, mentions_model FROM rough_graded", "rough_graded")
def project_signals(spark, sf_dir):
    found = projects.projects(applications(spark, sf_dir), STANDARD).filter(F.col("domain").isin(projects.AI_DOMAINS))
    text = projects.project_text(F.struct("name", "description", "technologies"))
    told = found.select("doc_id", "project_no", projects.signals(text, STANDARD).alias("signals"))
    return told.select("doc_id", "project_no", "signals.*", projects.signal_count(F.col("signals")).alias("signal_count"))


# another table: forms that share beginnings, stand inside each other, or differ by a hyphen
OTHER_SIGNALS = [
    ("licensing", "term", "license"), ("licensing", "term", "licensed under"), ("licensing", "phrase", "copyright"),
    ("articles", "term", "the"), ("articles", "term", "the of"), ("articles", "phrase", "th"), ("hyphen", "term", "re-use"),
    ("hyphen", "term", "re use"), ("ending", "phrase", "tion"), ("ending", "phrase", "tions"), ("french", "term", "le"),
    ("french", "term", "de la"), ("contact", "phrase", "@"), ("contact", "phrase", "http"), ("contact", "phrase", "https"),
]


def _shows(kind: str, form: str) -> str:
    if kind == "phrase":
        return f"contains(lower(text), '{form}')"
    return f"regexp_matches(lower(text), '{o.bounded(form)}')"


_OTHER = ", ".join(
    "(" + " OR ".join(_shows(k, f) for n, k, f in OTHER_SIGNALS if n == name) + f") AS {name}"
    for name in dict.fromkeys(n for n, _, _ in OTHER_SIGNALS)
)


@checked("text_signals", f"SELECT doc_id, {_OTHER} FROM documents")
def text_signals(spark, sf_dir):
    """Signals of another table, handed over as a table, in whole documents."""
    listed = spark.createDataFrame(OTHER_SIGNALS, "signal string, kind string, form string")
    wanted = sig.SignalTable.from_table(listed)
    found = documents(spark, sf_dir).select("doc_id", wanted.found(F.lower("text")).alias("found"))
    return found.select("doc_id", *[wanted.shows(F.col("found"), name).alias(name) for name in sorted(wanted.names())])


@checked("project_quality", """
    SELECT doc_id, shown AS name, quality / 10000.0 AS quality, signal_count, thin, tutorial_label FROM rough_graded""", "rough_graded")
def project_quality(spark, sf_dir):
    return graded_projects(spark, sf_dir).select(
        "doc_id", scoring.named(F.struct("name")).alias("name"),
        (F.col("quality").cast("double") / projects.QUALITY_UNIT).alias("quality"),
        "signal_count", "thin", "tutorial_label",
    )


@checked("project_summaries", f"""
    SELECT a.doc_id, {o.SUMMARY} AS project_summary FROM apps AS a LEFT JOIN rough_summary AS s USING (doc_id)""", "apps", "rough_summary")
def project_summaries(spark, sf_dir):
    return app_features(spark, sf_dir).select(
        "doc_id", projects.project_summary(F.col("projects"), PARAMS.limits).alias("project_summary")
    )


# ---------------------------------------------------------------------------
# Gate and categories
# ---------------------------------------------------------------------------
@checked("gate", """
    SELECT doc_id, has_text, has_python, has_core, has_general_project, eligible, array_to_string(reasons, ' | ') AS rejection_reasons
    FROM app_gate""", "app_gate")
def gate(spark, sf_dir):
    apps = applications(spark, sf_dir)
    units = sections.lines(apps).select("doc_id", "line", sections.source_of(F.col("section")).alias("source"))
    hits = matching.match_rows(units, ["doc_id", "source"], "line", STANDARD)
    return gates.gate(apps, hits).withColumn("rejection_reasons", joined("rejection_reasons"))


@checked("status_routing", """
    SELECT doc_id, candidate_name, is_eligible AS eligible, array_to_string(rejection_reasons, ' | ') AS rejection_reasons, parse_status
    FROM run_gate""", "run_gate")
def status_routing(spark, sf_dir):
    found = written(app_features(spark, sf_dir), "features")  # read more than once below
    routed = screening.with_gate(dedupe.mark_duplicates(found, PARAMS.hot_rows))
    return routed.select("doc_id", "candidate_name", "eligible", joined("rejection_reasons").alias("rejection_reasons"), "parse_status")


@checked("unreadable_times", """
    SELECT event_type, count(*) AS n, count(TRY_CAST(told AS TIMESTAMP)) AS readable,
           max(CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(TRY_CAST(told AS TIMESTAMP))) / 86400000000.0) AS INTEGER)) AS oldest_days
    FROM (SELECT event_type, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS told FROM events) AS e
    GROUP BY event_type""")
def unreadable_times(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    told = F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "soon").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    read = table(spark, sf_dir, "events").select("event_type", act.parse_time(told).alias("at"))
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("at").alias("readable"),
        F.max(act.days_between(F.col("at"), act.moment(PARAMS))).alias("oldest_days"),
    )


@checked("best_mentions", "SELECT doc_id, term, CAST(best_tenths AS INTEGER) AS best_tenths FROM best_mentions", "best_mentions")
def best_mentions(spark, sf_dir):
    return scoring.best_mentions(app_evidence(spark, sf_dir), PARAMS).select("doc_id", "term", "best_tenths")


@checked("weighted_scores", """
    SELECT doc_id, category, weighted_sum, points_hundredths / 100.0 AS points, array_to_string(terms, ', ') AS terms FROM weighted""",
    "weighted")
def weighted_scores(spark, sf_dir):
    return scoring.weighted_scores(app_evidence(spark, sf_dir), PARAMS).select(
        "doc_id", "category", "weighted_sum", as_points(F.col("points_hundredths")).alias("points"),
        joined("terms", ", ").alias("terms"),
    )


@checked("engineering_depth", """
    SELECT doc_id, least(500, 125 * len(terms)) / 100.0 AS points, array_to_string(terms, ', ') AS terms FROM engineering""",
    "engineering")
def engineering_depth(spark, sf_dir):
    found = app_evidence(spark, sf_dir).filter(
        (F.col("evidence_group") == "other") & F.col("term").isin(STANDARD.names("engineering"))
    ).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return found.select(
        "doc_id", as_points(scoring.engineering_hundredths(F.size("terms"), PARAMS)).alias("points"),
        joined("terms", ", ").alias("terms"),
    )


_DEPTH_N = "best * 67200 + least(3, solid) * 480000000 + best_signals * 180000000"


@checked("depth_and_penalties", f"""
    SELECT a.doc_id, CASE WHEN d.best IS NOT NULL THEN least(4000, {o.half_up(_DEPTH_N, 2400000)})
                          ELSE least(1000, 200 * coalesce(len(k.terms), 0)) END / 100.0 AS depth,
           - {o.half_up('least(150000, coalesce(d.taken, 0))', 100)} / 100.0 AS penalty,
           CASE WHEN d.best IS NULL AND k.terms IS NOT NULL THEN 'No concrete AI project evidence (framework names only)'
                WHEN d.best IS NULL THEN 'No AI project evidence'
                WHEN d.best < 30000 THEN 'AI project(s) look like thin wrappers (low depth)' ELSE '' END AS concerns
    FROM apps AS a LEFT JOIN rough_docs AS d USING (doc_id) LEFT JOIN core_terms AS k USING (doc_id)""", "apps", "rough_docs", "core_terms")
def depth_and_penalties(spark, sf_dir):
    graded = projects.with_graded_projects(app_features(spark, sf_dir), STANDARD, PARAMS.penalties)
    scored = scoring.with_penalties(scoring.with_depth(graded, PARAMS), PARAMS)
    return scored.select(
        "doc_id", as_points(F.col("depth")).alias("depth"), as_points(F.col("penalty")).alias("penalty"),
        joined("depth_concerns").alias("concerns"),
    )


# ---------------------------------------------------------------------------
# Activity
# ---------------------------------------------------------------------------
@checked("event_activity", "SELECT username, newest_event, recent_events FROM event_sums", "event_sums")
def event_activity(spark, sf_dir):
    return act.event_activity(composed(spark, sf_dir, corpus.ACTIVITY_EVENTS), PARAMS)


@checked("repo_relevance", "SELECT username, count(*) AS repos, count(*) FILTER (active) AS active, count(*) FILTER (relevant) AS relevant FROM repo_flags GROUP BY username", "repo_flags")
def repo_relevance(spark, sf_dir):
    repos = composed(spark, sf_dir, corpus.ACTIVITY_REPOS)
    counted = act.repo_activity(repos, STANDARD, PARAMS)
    per_user = repos.groupBy("username").agg(F.count("*").alias("repos"))
    return per_user.join(counted, "username").select(
        "username", "repos", F.col("active_repos").alias("active"), F.col("relevant_count").alias("relevant")
    )


@checked("activity", """
    SELECT username, status, activity_summary, activity_h / 100.0 AS recent_activity_score, repo_h / 100.0 AS repos_score,
           public_repos, days_since_last_activity, array_to_string(relevant_repos, ' | ') AS relevant_repos, error, flagged FROM activity""",
    "activity")
def activity(spark, sf_dir):
    t = activity_tables(spark, sf_dir)
    found = act.scored_activity(act.activity(t.profiles, t.events, t.repos, STANDARD, PARAMS))
    return found.drop("recent_events").withColumn("relevant_repos", joined("relevant_repos"))


@checked("recency_bands", """
    SELECT o_custkey, days, least(500, CASE WHEN days <= 30 THEN 400 WHEN days <= 90 THEN 300 WHEN days <= 180 THEN 200 WHEN days <= 365 THEN 100 ELSE 50 END
             + CASE WHEN n >= 5 THEN 100 WHEN n >= 2 THEN 50 ELSE 0 END) / 100.0 AS points
    FROM (SELECT o_custkey, CAST(min(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(o_orderdate)) / 86400000000.0)) AS INTEGER) AS days,
                 count(*) FILTER (o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) AS n
          FROM orders GROUP BY o_custkey) AS c""")
def recency_bands(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    params = ScreenParams(as_of=datetime(2001, 8, 1))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("username"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    days = act.days_between(F.col("newest_event"), act.moment(params))
    return act.event_activity(orders, params).select(
        F.col("username").alias("o_custkey"), days.alias("days"),
        as_points(act.activity_hundredths(days, F.col("recent_events"))).alias("points"),
    )


# ---------------------------------------------------------------------------
# Judgements
# ---------------------------------------------------------------------------
@checked("judgement_parse", "SELECT doc_id, failure, warning, CAST(CASE WHEN warning IS NULL THEN n END AS INTEGER) AS projects FROM judged_checked", "judged_checked")
def judgement_parse(spark, sf_dir):
    parsed = judgements.judgements(composed(spark, sf_dir, corpus.RESPONSES), PARAMS.limits)
    return parsed.select(
        "doc_id", "failure", "warning",
        F.when(F.col("judged_projects").isNotNull(), F.size("judged_projects")).alias("projects"),
    )


@checked("judged_projects", f"""
    SELECT doc_id, project_no, name, description, array_to_string(technologies, ' | ') AS technologies, domain, quality_score,
           quality_rationale, is_thin_wrapper, is_tutorial, {", ".join(f"j_{s} AS {s}" for s in o.SIGNAL_NAMES)} FROM judged_projects""",
    "judged_projects")
def judged_projects(spark, sf_dir):
    parsed = judgements.judgements(composed(spark, sf_dir, corpus.RESPONSES), PARAMS.limits)
    listed = parsed.select("doc_id", F.posexplode_outer("judged_projects").alias("project_no", "p")).filter("p IS NOT NULL")
    return listed.select(
        "doc_id", "project_no", "p.name", "p.description", joined("p.technologies").alias("technologies"), "p.domain",
        "p.quality_score", "p.quality_rationale", "p.is_thin_wrapper", "p.is_tutorial", "p.signals.*",
    )


@checked("refined_projects", """
    SELECT r.doc_id, r.project_no, r.name, r.domain, r.quality_score FROM refined_projects AS r""", "refined_projects")
def refined_projects(spark, sf_dir):
    parsed = judgements.judgements(composed(spark, sf_dir, corpus.RESPONSES), PARAMS.limits)
    both = app_features(spark, sf_dir).select("doc_id", "projects").join(parsed, "doc_id", "left")
    refined = judgements.refined_projects(F.col("projects"), F.col("judged_projects"))
    listed = both.select("doc_id", F.posexplode_outer(refined).alias("project_no", "p")).filter("p IS NOT NULL")
    return listed.select("doc_id", "project_no", "p.name", "p.domain", "p.quality_score")


o.cte("given_fields", """
    SELECT doc_id, warning, trim(coalesce(j->>'$.candidate_name', '')) AS given_name,
           list_filter(list_transform(coalesce(CAST(j->'$.skills' AS VARCHAR[]), CAST([] AS VARCHAR[])), lambda s: trim(s)), lambda s: s <> '') AS given_skills,
           coalesce(CAST(j->'$.experience_highlights' AS VARCHAR[]), CAST([] AS VARCHAR[])) AS given_experience, n
    FROM given_checked WHERE warning IS NULL""", "given_checked")


@checked("merged_profiles", f"""
    SELECT a.doc_id, CASE WHEN g.doc_id IS NOT NULL AND g.given_name <> '' AND {o.words('g.given_name')} <= 5 AND NOT regexp_matches(g.given_name, '[0-9]')
                THEN g.given_name ELSE a.candidate_name END AS candidate_name,
           array_to_string(list_concat(coalesce(s.skills, CAST([] AS VARCHAR[])),
             list_filter(coalesce(g.given_skills, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(coalesce(s.skills, CAST([] AS VARCHAR[])), x))), ' | ') AS skills,
           CASE WHEN coalesce(g.n, 0) > 0 THEN CAST(g.n AS INTEGER) ELSE CAST(coalesce(p.n, 0) AS INTEGER) END AS n_projects,
           CASE WHEN len(g.given_experience) > 0 THEN array_to_string(g.given_experience, ' | ') ELSE coalesce(e.section_text, '') END AS experience,
           CASE WHEN g.doc_id IS NOT NULL THEN 'hybrid' ELSE 'deterministic' END AS extraction_method,
           coalesce(c.warning, '') AS warnings
    FROM app_names AS a LEFT JOIN app_skills AS s USING (doc_id) LEFT JOIN given_fields AS g USING (doc_id)
    LEFT JOIN given_checked AS c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM app_projects GROUP BY doc_id) AS p USING (doc_id)
    LEFT JOIN (SELECT * FROM section_text WHERE section = 'experience') AS e USING (doc_id)""",
    "app_names", "app_skills", "given_fields", "given_checked", "app_projects", "section_text")
def merged_profiles(spark, sf_dir):
    apps = applications(spark, sf_dir)
    experience = sections.section_texts(apps).filter(F.col("section") == "experience").select("doc_id", "section_text")
    base = app_features(spark, sf_dir).select("doc_id", "candidate_name", "skills", "projects", "has_text").join(experience, "doc_id", "left").select(
        "doc_id", "candidate_name", "skills", "projects", "has_text",
        F.array_compact(F.array("section_text")).alias("experience"),
    )
    given = judgements.extractions(composed(spark, sf_dir, corpus.EXTRACTION_RESPONSES), PARAMS.limits)
    return judgements.merged(base, given).select(
        "doc_id", "candidate_name", joined("skills").alias("skills"), F.size("projects").alias("n_projects"),
        joined("experience").alias("experience"), "extraction_method", joined("warnings").alias("warnings"),
    )


# ---------------------------------------------------------------------------
# The whole run
# ---------------------------------------------------------------------------
@checked("score_breakdown", """
    SELECT doc_id, ai / 100.0 AS ai_project_depth, py / 100.0 AS python_backend, cl / 100.0 AS cloud_fullstack, gh / 100.0 AS github,
           en / 100.0 AS engineering_depth, -pen / 100.0 AS penalties, total / 100.0 AS total_score FROM run WHERE is_eligible""", "run")
def score_breakdown(spark, sf_dir):
    return results(spark, sf_dir).filter("eligible").select(
        "doc_id", *[F.col(f"score_breakdown.{c}").alias(c) for c in scoring.CATEGORIES], "total_score"
    )


@checked("score_reasons", """
    SELECT doc_id, array_to_string(ai_reasons, ' | ') AS ai_project_depth, py_reason AS python_backend, cl_reason AS cloud_fullstack,
           gh_reason AS github, en_reason AS engineering_depth, array_to_string(pen_reasons, ' | ') AS penalties FROM run WHERE is_eligible""", "run")
def score_reasons(spark, sf_dir):
    rationale = F.col("score_breakdown.rationale")
    return results(spark, sf_dir).filter("eligible").select(
        "doc_id", *[joined(rationale[c]).alias(c) for c in scoring.CATEGORIES]
    )


@checked("strengths_concerns", """
    SELECT doc_id, array_to_string(list_filter([CASE WHEN ai >= 2400 THEN 'Strong AI/agentic project depth' END,
             CASE WHEN py >= 1800 THEN 'Solid Python/backend engineering evidence' END,
             CASE WHEN cl >= 900 THEN 'Cloud/deployment and full-stack exposure' END,
             CASE WHEN gh_status = 'ok' AND activity_h + repo_h >= 500 THEN 'Active, relevant public GitHub' END], lambda x: x IS NOT NULL), ' | ') AS strengths,
           array_to_string(list_filter([CASE WHEN ai <= 1000 THEN 'Limited AI project depth' END,
             CASE WHEN py <= 900 THEN 'Weak Python/backend evidence' END,
             CASE WHEN cl <= 300 THEN 'Little cloud/deployment evidence' END,
             CASE WHEN pen > 0 THEN 'Project-quality penalties applied (see score breakdown)' END,
             CASE WHEN gh_flagged THEN concat('GitHub unavailable (', gh_status, ') — tagged, neutral placeholder applied')
                  WHEN gh_status <> 'ok' AND gh_username <> '' THEN concat('GitHub not enriched (', gh_status, ')') END], lambda x: x IS NOT NULL), ' | ') AS concerns
    FROM run WHERE is_eligible""", "run")
def strengths_concerns(spark, sf_dir):
    return results(spark, sf_dir).filter("eligible").select(
        "doc_id", joined("strengths").alias("strengths"), joined("concerns").alias("concerns")
    )


@checked("enrichment", """
    SELECT doc_id, gh_status AS status, gh_username AS username, gh_summary AS summary, activity_h / 100.0 AS recent_activity_score,
           repo_h / 100.0 AS repos_score, gh_flagged AS flagged FROM run""", "run")
def enrichment(spark, sf_dir):
    g = F.col("github")
    return results(spark, sf_dir).select(
        "doc_id", *[g[c].alias(c) for c in ("status", "username", "summary", "recent_activity_score", "repos_score", "flagged")]
    )


@checked("baseline_vs_refined", """
    SELECT doc_id, base_total / 100.0 AS baseline, total / 100.0 AS refined, base_ai / 100.0 AS baseline_depth, ai / 100.0 AS refined_depth,
           judged, coalesce(warning, '') AS warnings FROM run WHERE is_eligible""", "run")
def baseline_vs_refined(spark, sf_dir):
    return results(spark, sf_dir).filter("eligible").select(
        "doc_id", F.col("deterministic_total_score").alias("baseline"), F.col("total_score").alias("refined"),
        F.col("deterministic_breakdown.ai_project_depth").alias("baseline_depth"),
        F.col("llm_ai_project_depth").alias("refined_depth"), F.col("llm_applied").alias("judged"),
        joined("warnings").alias("warnings"),
    )


@checked("rank", "SELECT doc_id, rank, total / 100.0 AS total_score FROM ranked", "ranked")
def rank(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", "rank", "total_score")


@checked("output_order", "SELECT doc_id, position, candidate_name, source_file FROM ranked", "ranked")
def output_order(spark, sf_dir):
    return results(spark, sf_dir).select("doc_id", "position", "candidate_name", "source_file")


@checked("json_report", """
    SELECT doc_id, position, rank, candidate_name, CASE WHEN is_eligible THEN total / 100.0 END AS total_score,
           array_to_string(rejection_reasons, ' | ') AS rejection_reasons, parse_status, true AS in_place FROM ranked""", "ranked")
def json_report(spark, sf_dir):
    """Written as files in rank order, read back by the manifest; ``in_place``: the row stands where its position says."""
    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    reports.write_json(run(spark, sf_dir), folder)
    files_of = ordered.manifest(spark, f"{folder}/candidates")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = spark.read.text(f"{folder}/candidates").select(
        name.alias("file"), F.monotonically_increasing_id().alias("at"),
        F.get_json_object("value", "$.position").cast("long").alias("told"),
    )
    # a file holds one range of positions: its lines are numbered on their own
    nth = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    placed = lines.withColumn("nth", nth).join(F.broadcast(files_of), "file").select(
        F.col("told").alias("position"), (F.col("told") == F.col("first") + F.col("nth") - 1).alias("in_place")
    )
    back = reports.read_json(spark, folder).select(
        "doc_id", "position", "rank", "candidate_name", "total_score",
        joined("rejection_reasons").alias("rejection_reasons"), "parse_status",
    )
    return back.join(placed, "position")


_LANDED = """
    SELECT kind, coalesce(fault, 'sound') AS fault, count(*) AS n, count(DISTINCT CASE WHEN fault IS NULL THEN username END) AS users,
           sum(CASE WHEN fault IS NULL THEN amount ELSE 0 END) AS amount
    FROM (
      SELECT 'profiles' AS kind, username, public_repos AS amount, http_status = 404 AS mistyped FROM profiles UNION ALL
      SELECT 'events', username, CASE WHEN created_at IS NULL THEN 0 ELSE 1 END, false FROM event_lines UNION ALL
      SELECT 'repos', username, CASE WHEN fork THEN 1 ELSE 0 END, false FROM repo_lines
    ) AS r, LATERAL (SELECT CASE WHEN ascii(right(username, 1)) % 5 = 0 OR mistyped THEN 'unreadable line'
                                 WHEN ascii(right(username, 1)) % 5 = 1 THEN 'no key' END AS fault) AS f
    GROUP BY ALL"""
o.cte("event_lines", corpus.duckdb_sql(corpus.ACTIVITY_EVENTS))
o.cte("repo_lines", corpus.duckdb_sql(corpus.ACTIVITY_REPOS))


@checked("landed_round_trip", _LANDED, "profiles", "event_lines", "repo_lines")
def landed_round_trip(spark, sf_dir):
    """Snapshots written as lines, some of them spoilt, then landed: what is sound, and what went to quarantine."""
    folder = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    told = []
    amounts = {
        "profiles": F.col("public_repos"), "events": F.col("created_at").isNotNull().cast("int"), "repos": F.col("fork").cast("int"),
    }
    inputs = {"profiles": corpus.ACTIVITY_PROFILES, "events": corpus.ACTIVITY_EVENTS, "repos": corpus.ACTIVITY_REPOS}
    for kind in (landed.PROFILE_LINES, landed.EVENT_LINES, landed.REPO_LINES):
        rows = composed(spark, sf_dir, inputs[kind.name])
        spoil = F.ascii(F.right("username", F.lit(1))) % 5
        line = F.regexp_replace(F.to_json(F.struct("*")), '"http_status":404', '"http_status":"gone"')
        cut = F.left("line", F.length("line") - 3)
        keyless = F.regexp_replace("line", '"username":"[^"]*",?', "")
        spoilt = F.when(spoil == 0, cut).when(spoil == 1, keyless).otherwise(F.col("line"))
        rows.withColumn("line", line).select(spoilt.alias("value")).write.text(f"{folder}/{kind.name}")
        good = landed.land(spark, f"{folder}/{kind.name}", kind, f"{folder}/quarantine")
        told.append(good.agg(
            F.lit(kind.name).alias("kind"), F.lit("sound").alias("fault"), F.count("*").alias("n"),
            F.count_distinct("username").alias("users"), F.sum(amounts[kind.name]).alias("amount"),
        ))
    set_aside = landed.quarantined(spark, f"{folder}/quarantine").groupBy("kind", "fault").agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("users"), F.lit(0).cast("long").alias("amount")
    )
    return told[0].union(told[1]).union(told[2]).union(set_aside)


@checked("ranked_and_rejected", """
    SELECT 'ranked' AS part, doc_id, rank FROM ranked WHERE is_eligible UNION ALL SELECT 'rejected', doc_id, NULL FROM ranked WHERE NOT is_eligible""", "ranked")
def ranked_and_rejected(spark, sf_dir):
    rows = results(spark, sf_dir)
    first = rows.filter("eligible").select(F.lit("ranked").alias("part"), "doc_id", "rank")
    last = rows.filter(~F.col("eligible")).select(F.lit("rejected").alias("part"), "doc_id")
    return reports.eligible_then_rejected(first, last)


@checked("batch_summary", """
    SELECT count(*) AS total_resumes, count(*) FILTER (parse_status = 'ok') AS parsed_ok, count(*) FILTER (parse_status IN ('failed', 'empty')) AS parse_failed,
           count(*) FILTER (parse_status = 'duplicate') AS duplicates_skipped, count(*) FILTER (is_eligible) AS eligible, count(*) FILTER (NOT is_eligible) AS rejected,
           bool_or(judged) AS llm_used, count(*) FILTER (gh_status = 'ok') AS github_enriched, count(*) FILTER (gh_status IN ('rate_limited', 'error')) AS github_failures,
           count(*) FILTER (judged) AS llm_scored, count(*) FILTER (gh_status = 'rate_limited') AS github_tagged_rate_limited,
           count(*) FILTER (gh_status = 'error') AS github_tagged_error, count(*) FILTER (gh_status = 'no_profile') AS github_no_profile,
           count(*) FILTER (parse_status = 'ok') - count(*) FILTER (is_eligible) AS llm_skipped_by_gate FROM run""", "run")
def batch_summary(spark, sf_dir):
    return run(spark, sf_dir).summary


FLAT = """
    SELECT r.rank, r.candidate_name, r.is_eligible AS eligible, r.base_total / 100.0 AS det_total_score, r.total / 100.0 AS total_score,
           round((r.total - r.base_total) / 100.0, 2) AS llm_delta, r.ai / 100.0 AS ai_project_depth, r.base_ai / 100.0 AS ai_project_depth_deterministic,
           r.py / 100.0 AS python_backend, r.cl / 100.0 AS cloud_fullstack, CASE WHEN r.is_eligible THEN r.gh / 100.0 END AS github, r.en / 100.0 AS engineering_depth,
           -r.pen / 100.0 AS penalties, array_to_string(r.skills, '; ') AS matched_skills, array_to_string(r.rejection_reasons, '; ') AS rejection_reasons, r.source_file
    FROM ranked AS r"""


@checked("flat_output", FLAT, "ranked")
def flat_output(spark, sf_dir):
    return reports.flat(results(spark, sf_dir))


def landed_twice(table: DataFrame, **earlier: Column) -> DataFrame:
    """A landed table that has every row again, as it was fetched before."""
    then = table.withColumns(earlier).withColumn("arrived_at", F.lit(1))
    return then.unionByName(table.withColumn("arrived_at", F.lit(2))).unionByName(then)


@checked("repeated_responses", FLAT, "ranked")
def repeated_responses(spark, sf_dir):
    responses = landed_twice(composed(spark, sf_dir, corpus.RESPONSES), response=F.lit("zzz"))
    apps = applications(spark, sf_dir)
    return reports.flat(screening.screen(apps, STANDARD, PARAMS, activity_tables(spark, sf_dir), responses).results)


@checked("repeated_profiles", FLAT, "ranked")
def repeated_profiles(spark, sf_dir):
    landed = activity_tables(spark, sf_dir)
    twice = screening.ActivityTables(landed_twice(landed.profiles, http_status=F.lit(999)), landed.events, landed.repos)
    responses = composed(spark, sf_dir, corpus.RESPONSES)
    return reports.flat(screening.screen(applications(spark, sf_dir), STANDARD, PARAMS, twice, responses).results)


@checked("shortlist", f"""
    SELECT rank, candidate_name, base_total / 100.0 AS det_total_score, total / 100.0 AS total_score, round((total - base_total) / 100.0, 2) AS delta,
           base_ai / 100.0 AS ai_project_depth_deterministic, ai / 100.0 AS ai_project_depth, py / 100.0 AS python_backend, cl / 100.0 AS cloud_fullstack,
           gh / 100.0 AS github, en / 100.0 AS engineering_depth, -pen / 100.0 AS penalties FROM ranked WHERE rank <= {TOP}""", "ranked")
def shortlist(spark, sf_dir):
    return reports.shortlist(results(spark, sf_dir), TOP)


@checked("shortlist_rest", f"SELECT greatest(0, count(*) FILTER (is_eligible) - {TOP}) AS more FROM run", "run")
def shortlist_rest(spark, sf_dir):
    return reports.more_than(results(spark, sf_dir), TOP)


@checked("category_comparison", """
    SELECT rank, doc_id, category, baseline, refined, round(refined - baseline, 2) AS change FROM (
      SELECT rank, doc_id, unnest(['ai_project_depth', 'python_backend', 'cloud_fullstack', 'github', 'engineering_depth', 'penalties', 'total']) AS category,
             unnest([base_ai / 100.0, py / 100.0, cl / 100.0, gh / 100.0, en / 100.0, -base_pen / 100.0, base_total / 100.0]) AS baseline,
             unnest([ai / 100.0, py / 100.0, cl / 100.0, gh / 100.0, en / 100.0, -pen / 100.0, total / 100.0]) AS refined
      FROM ranked WHERE is_eligible) AS c""", "ranked")
def category_comparison(spark, sf_dir):
    return reports.comparison(results(spark, sf_dir))


@checked("rejected", """
    SELECT doc_id, candidate_name, array_to_string(rejection_reasons, '; ') AS reasons, array_to_string(skills[1:10], ', ') AS skills, source_file
    FROM run WHERE NOT is_eligible""", "run")
def rejected(spark, sf_dir):
    return reports.rejected(results(spark, sf_dir))


@checked("top_reasons", f"""
    SELECT r.rank, r.candidate_name, r.total / 100.0 AS total_score, array_to_string(ai_reasons[1:3], ' | ') AS reasons,
           array_to_string(list_filter(pen_reasons, lambda p: NOT contains(p, 'No project-quality')), ' | ') AS penalties,
           CASE WHEN gh_summary <> '' THEN gh_summary END AS activity,
           CASE WHEN length(told) <= 240 THEN told ELSE concat(regexp_replace(left(told, 240), ' [^ ]*$', ''), '…') END AS project
    FROM (SELECT k.*, {o.squeeze(o.SUMMARY)} AS told FROM ranked AS k LEFT JOIN refined_summary AS s USING (doc_id) WHERE k.rank <= 5) AS r""",
    "ranked", "refined_summary")
def top_reasons(spark, sf_dir):
    return reports.top_reasons(results(spark, sf_dir), 5).withColumns(
        {"reasons": joined("reasons"), "penalties": joined("penalties")}
    )


@checked("scores_by_label", """
    SELECT l.quality, l.toxic, count(*) AS n, count(*) FILTER (r.is_eligible) AS eligible, avg(r.total) / 100.0 AS mean_score
    FROM run AS r JOIN labels AS l USING (doc_id) GROUP BY ALL""", "run")
def scores_by_label(spark, sf_dir):
    rows = results(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("eligible"),
        (F.avg("total_hundredths") / 100.0).alias("mean_score"),
    )
