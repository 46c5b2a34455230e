"""Projects: splitting the projects section, domains, signals, quality and penalties.

Rules are written as Column functions over one project struct, so the same rule runs
on a table of projects or inside an array of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.points import half_up
from evisift.functions.text import any_of, clipped, escape, is_blank, let, squeeze, strip, word_count
from evisift.operators.matching import match_rows, skill_list
from evisift.operators.sections import SECTION_ALIASES, with_line_sections
from evisift.operators.signals import PHRASE, TERM, SignalTable
from evisift.params import Limits, Penalties, Thresholds
from evisift.vocabulary import Vocabulary

# Fixed values.
DATE = (
    r"(?i)20\p{Nd}{2}|19\p{Nd}{2}"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\p{Nd}{4}\b"
    r"|\bpresent\b"
)
BULLETS = ["-", "•", "*", "–", "—", "▪", "◦", "‣"]
LONG_TITLE, SHORT_TITLE, TITLE_WORDS = 160, 90, 8

WEB_TERMS = ["React", "Next.js", "Tailwind", "Node.js", "Express", "TypeScript", "JavaScript"]
DATA_TERMS = ["Pandas", "NumPy", "SQL", "PostgreSQL", "MySQL", "MongoDB", "scikit-learn", "SciPy"]
AI_DOMAINS = ["ai_agentic", "ai_general"]
DOMAINS = ["ai_agentic", "ai_general", "web_fullstack", "data", "other", "unknown"]

TUTORIAL_MARKERS = ["tutorial", "follow-along", "follow along", "clone of", "from youtube",
                    "course project"]

MODEL_TERMS = ["LLM", "OpenAI API", "Anthropic", "Gemini", "Hugging Face", "Fine-tuning",
               "LangChain", "LlamaIndex", "MCP", "Prompt Engineering", "DSPy"]
#: What a table calls the forms that name a model.
MODEL = "mentions_model"


@dataclass(frozen=True)
class Signal:
    """One thing a project can show: vocabulary terms or plain substrings that show it."""

    name: str
    weight: int  # hundredths of a quality point
    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    groups: tuple[str, ...] = ("ai",)
    workflow: bool = True  # counts as real system depth


# Fixed values, in output order.
SIGNALS = [
    Signal("retrieval", 150,
           ("RAG", "Embeddings", "Vector Search", "Pinecone", "FAISS", "Chroma", "Weaviate",
            "Qdrant", "pgvector"),
           ("retriev", "semantic search")),
    Signal("tool_use", 100, ("Tool Calling",), ("tool call", "function call")),
    Signal("state_or_memory", 100, (),
           ("memory", "state", "session", "conversation history", "persist")),
    Signal("orchestration", 150,
           ("LangGraph", "CrewAI", "AutoGen", "Google ADK", "Multi-Agent", "AI Agents",
            "Semantic Kernel", "Haystack", "DSPy"),
           ("workflow", "multi-step", "planner")),
    Signal("evaluation", 100, ("Evaluation", "LangSmith"),
           ("evaluat", "benchmark", "guardrail")),
    Signal("product_logic", 100, (),
           ("user", "customer", "dashboard", "product", "business", "deploy"), workflow=False),
    Signal("backend_logic", 100,
           ("PostgreSQL", "MySQL", "MongoDB", "Redis", "REST API", "Kafka", "RabbitMQ", "gRPC",
            "GraphQL", "WebSockets", "Docker", "GCP", "AWS", "Kubernetes", "FastAPI", "Django",
            "Flask", "Celery"),
           ("message queue", "task queue", "endpoint", "microservice", "rest api"),
           groups=("backend", "cloud", "python")),
    Signal("data_processing", 100, (),
           ("pipeline", "etl", "chunk", "preprocess", "clean", "vectoriz"), workflow=False),
]
SIGNAL_TYPE = "struct<" + ",".join(f"{s.name}:boolean" for s in SIGNALS) + ">"
QUALITY_BASE, QUALITY_MAX, QUALITY_SHALLOW = 200, 1000, 300

# Qualities are whole ten-thousandths of a point; 10 points are 100,000.
QUALITY_UNIT = 10_000
HUNDREDTH = QUALITY_UNIT // 100


def is_title(line: Column) -> Column:
    """TRUE for a line that looks like the title of a project."""
    def of_stripped(text: Column) -> Column:
        led = text.rlike("^" + any_of(BULLETS))
        marked = text.contains("|") | text.rlike(DATE)
        plain = (F.length(text) <= SHORT_TITLE) & (word_count(text) <= TITLE_WORDS)
        fits = F.when(marked, F.length(text) <= LONG_TITLE).otherwise(plain)
        return (F.length(text) > 0) & ~led & ~text.endswith(".") & fits

    return let(strip(line), of_stripped)


def with_project_blocks(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``blocks``: ``array<struct<name, description, body>>`` from ``line_sections``.

    A block starts at the first line of the projects section and at each title-like line.
    """
    keep = docs.columns
    numbered = docs.withColumn(
        "_own",
        F.transform(
            F.filter(
                "line_sections",
                lambda x: (x["section"] == "projects") & ~is_blank(x["line"]),
            ),
            lambda x: x["line"],
        ),
    )
    starts = numbered.withColumn(
        "_starts",
        F.filter(
            F.transform("_own", lambda line, i: F.when((i == 0) | is_title(line), i)),
            lambda i: i.isNotNull(),
        ),
    )
    cut = starts.withColumn(
        "_cut",
        F.transform(
            "_starts",
            lambda start, k: F.slice(
                F.col("_own"),
                start + 1,
                F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_own")) - start,
            ),
        ),
    )

    def block(lines: Column) -> Column:
        title = strip(F.get(lines, F.lit(0)))
        rest = strip(F.array_join(F.slice(lines, 2, 2**30), "\n"))
        tail = F.when(title.contains("|"), strip(F.regexp_extract(title, r"(?s)^[^|]*\|(.*)$", 1)))
        return F.struct(
            clipped(strip(F.substring_index(title, "|", 1)), limits.title).alias("name"),
            clipped(
                F.when(F.length(rest) > 0, rest).otherwise(F.coalesce(tail, F.lit(""))), limits.description
            ).alias("description"),
            F.array_join(lines, "\n").alias("body"),
        )

    return cut.select(*keep, F.transform("_cut", block).alias("blocks"))


def domain_rank(grp: Column, canonical: Column, tier: Column) -> Column:
    """How strongly one term decides a project's domain; the smallest rank wins."""
    return (
        F.when(tier == "core", 0)
        .when(grp == "ai", 1)
        .when(canonical.isin(WEB_TERMS), 2)
        .when(canonical.isin(DATA_TERMS), 3)
        .otherwise(4)
    )


def domain_of(rank: Column) -> Column:
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.coalesce(F.get(names, rank), F.lit("unknown"))


def projects(
    docs: DataFrame,
    vocab: Vocabulary | DataFrame,
    limits: Limits = Limits(),
    aliases: Mapping = SECTION_ALIASES,
) -> DataFrame:
    """``(doc_id, project_no, name, description, technologies, domain)``."""
    blocks = (
        with_project_blocks(with_line_sections(docs.select("doc_id", "text"), aliases), limits)
        .select("doc_id", F.posexplode_outer("blocks").alias("project_no", "b"))
        .filter("project_no IS NOT NULL")
        .select("doc_id", "project_no", "b.*")
    )
    found = (
        match_rows(blocks, ["doc_id", "project_no"], "body", vocab)
        .groupBy("doc_id", "project_no")
        .agg(
            F.collect_set("canonical").alias("technologies"),
            F.min(domain_rank(F.col("grp"), F.col("canonical"), F.col("tier"))).alias("_rank"),
        )
    )
    return blocks.join(found, ["doc_id", "project_no"], "left").select(
        "doc_id", "project_no", "name", "description",
        F.array_sort(F.coalesce("technologies", F.array().cast("array<string>"))).alias("technologies"),
        domain_of(F.col("_rank")).alias("domain"),
    )


def project_text(project: Column) -> Column:
    return F.concat_ws(
        " ", project["name"], project["description"],
        F.array_join(project["technologies"], " "),
    )


def standard_signals(vocab: Vocabulary) -> SignalTable:
    """The fixed signals above as rows: surface forms of their terms, phrases, and the two marks that are no signals."""
    def rows():
        for s in SIGNALS:
            yield from ((s.name, TERM, form) for form in vocab.surfaces(s.terms, s.groups))
            yield from ((s.name, PHRASE, form) for form in s.phrases)
        yield from ((MODEL, TERM, form) for form in vocab.surfaces(MODEL_TERMS, ("ai",)))

    return SignalTable.of(rows())


def signals(text: Column, table: SignalTable | Vocabulary) -> Column:
    """The struct of signals a project's text shows, and ``mentions_model``; the text is looked through once for all."""
    table = standard_signals(table) if isinstance(table, Vocabulary) else table

    def told(found: Column) -> Column:
        names = [s.name for s in SIGNALS] + [MODEL]
        return F.struct(*[table.shows(found, name).alias(name) for name in names])

    return let(F.lower(text), lambda lowered: let(table.found(lowered), told))


def signal_count(found: Column) -> Column:
    count = F.lit(0)
    for signal in SIGNALS:
        count = count + F.coalesce(found[signal.name], F.lit(False)).cast("int")
    return count


def has_workflow(found: Column) -> Column:
    flag = F.lit(False)
    for signal in SIGNALS:
        if signal.workflow:
            flag = flag | F.coalesce(found[signal.name], F.lit(False))
    return flag


def estimated_quality(found: Column) -> Column:
    """Quality in ten-thousandths, estimated from the signals."""
    score = F.lit(QUALITY_BASE)
    for signal in SIGNALS:
        score = score + F.when(found[signal.name], signal.weight).otherwise(0)
    most = F.when(has_workflow(found), QUALITY_MAX).otherwise(QUALITY_SHALLOW)
    return F.least(score, most).cast("long") * HUNDREDTH


def tutorial_label(project: Column, detail_words: int, markers: Sequence[str] = tuple(TUTORIAL_MARKERS)) -> Column:
    """Why a project counts as a tutorial or undetailed, or NULL."""
    told = F.lower(F.concat_ws(" ", project["name"], project["description"]))
    return (
        F.when(project["is_tutorial"], F.lit("tutorial/boilerplate"))
        .when(told.rlike("|".join(map(escape, markers)) or "(?!)"), F.lit("tutorial-style"))
        .when(
            word_count(project["description"]) < detail_words,
            F.lit("listed without implementation detail"),
        )
    )


def thin_deduction(quality: Column, penalties: Penalties) -> Column:
    """Deduction of a thin project in ten-thousandths, deeper for lower quality."""
    span = penalties.thin_max - penalties.thin_min
    within = F.greatest(F.lit(0), F.least(F.lit(10 * QUALITY_UNIT), quality))
    return F.lit(penalties.thin_min * QUALITY_UNIT) + F.lit(span * QUALITY_UNIT) - half_up(within * span, 10)


def assessed(
    project: Column, table: SignalTable, penalties: Penalties, markers: Sequence[str] = tuple(TUTORIAL_MARKERS)
) -> Column:
    """A project with its signals, quality, thinness and tutorial label.

    A judged project (``quality_score`` present) keeps the judge's signals and score.
    """
    judged = project["quality_score"].isNotNull()

    def of_text(shown: Column) -> Column:
        names = [s.name for s in SIGNALS]
        own = F.when(judged, project["signals"].cast(SIGNAL_TYPE)).otherwise(
            F.struct(*[shown[name].alias(name) for name in names]).cast(SIGNAL_TYPE)
        )
        return F.struct(
            project["name"].alias("name"),
            project["quality_rationale"].alias("quality_rationale"),
            F.round(project["quality_score"] * QUALITY_UNIT).cast("long").alias("judged_quality"),
            own.alias("signals"),
            shown[MODEL].alias(MODEL),
            F.coalesce(project["is_thin_wrapper"], F.lit(False)).alias("is_thin_wrapper"),
            tutorial_label(project, penalties.detail_words, markers).alias("tutorial_label"),
        )

    return let(signals(project_text(project), table), of_text)


def graded(project: Column) -> Column:
    """An assessed project with the numbers the score needs."""
    return F.struct(
        project["name"].alias("name"),
        project["quality_rationale"].alias("quality_rationale"),
        F.coalesce(project["judged_quality"], estimated_quality(project["signals"])).alias("quality"),
        signal_count(project["signals"]).alias("signal_count"),
        (
            project["is_thin_wrapper"]
            | (project["mentions_model"] & ~has_workflow(project["signals"]))
        ).alias("thin"),
        project["tutorial_label"].alias("tutorial_label"),
    )


def with_graded_projects(
    rows: DataFrame, vocab: Vocabulary, penalties: Penalties = Penalties(),
    projects: str = "projects", into: str = "graded",
    table: SignalTable | None = None, markers: Sequence[str] | None = None,
) -> DataFrame:
    """Add the graded AI projects of each row, in order.

    ``table`` and ``markers`` take the place of the fixed signals and tutorial markers; the signals keep their names.
    """
    table = standard_signals(vocab) if table is None else table
    markers = TUTORIAL_MARKERS if markers is None else markers
    ai_only = F.filter(projects, lambda p: p["domain"].isin(AI_DOMAINS))
    assessed_rows = rows.withColumn(
        "_assessed", F.transform(ai_only, lambda p: assessed(p, table, penalties, markers))
    )
    return assessed_rows.withColumn(into, F.transform("_assessed", graded)).drop("_assessed")


def project_summary(projects: Column, limits: Limits = Limits()) -> Column:
    """One line about the first project."""
    first = F.get(projects, F.lit(0))
    name = F.when(F.length(first["name"]) > 0, first["name"]).otherwise("Untitled project")
    told = squeeze(F.coalesce(first["description"], F.lit("")))
    return (
        F.when(F.size(projects) == 0, F.lit("No projects described."))
        .when(F.length(told) > 0, F.concat(name, F.lit(": "), clipped(told, limits.summary)))
        .otherwise(name)
    )
