"""Inputs of the checked queries, composed in SQL from the given tables.

Every statement is valid in Spark and in DuckDB, so the check needs no fixture files.
The profile of an application depends on the length of its document's text, so exact
copies of a text stay exact copies. People and projects are invented.
"""

from __future__ import annotations

PROFILES = [
    # agents with retrieval, work experience, deployment
    "Mira Solano~mira.solano{k}@example.org | github.com/user{k}~~Summary~Engineer who builds agents in Python.~~"
    "Skills: Python, FastAPI, LangGraph, PostgreSQL, Docker, GCP, Redis~~Projects~"
    "Claims Desk Assistant | LangGraph, pgvector~"
    "- Multi-agent workflow in LangGraph with retrieval over pgvector embeddings and tool calling.~"
    "- Persistent session memory, an evaluation pipeline with guardrails, served to users by FastAPI on Cloud Run.~"
    "Ledger Explorer 2023~- Chunked filings with a retrieval pipeline and semantic search for analysts, with REST API endpoints.~"
    "~Experience~Platform Engineer, Northwind Works 2021 - 2023~"
    "- Async FastAPI services with Redis caching, Kafka queues, unit tests, monitoring and CI/CD on Kubernetes.~~"
    "Achievements~{text}",
    # retrieval for a data team, evidence mostly from work
    "Teo Brandt~teo_brandt{k}@example.org~https://github.com/user{k}/tools~~Work Experience~"
    "Data Engineer, Harbor Analytics~- Built a RAG service with embeddings in Weaviate and vector search over reports.~"
    "- Streaming pipelines with Kafka, Pandas and PostgreSQL, deployed with Terraform on AWS.~{text}~~"
    "Technical Skills~Python, Pandas, NumPy, SQL, RabbitMQ, Celery, Docker~~Education~BSc, Example University",
    # backend without models
    "Ines Calder~ines.calder@example.org~Skills: Python, Django, Flask, PostgreSQL, MySQL~Projects~Parcel Tracker~"
    "REST API in Django with PostgreSQL, JWT authentication and pytest test suite for couriers.~"
    "Night Rota~Flask site with MySQL for planning shifts.~Awards~{text}",
    # front end only
    "Oskar Lindqvist~oskar@example.org~Objective~Front end work.~Skills: JavaScript, TypeScript, React, Next.js, Tailwind~"
    "Personal Projects:~Plant Shop~Storefront in Next.js with checkout and a dashboard for customers.~{text}",
    # Java only
    "Priya Venkat~+44 20 7946 0000~Tech Stack: Java, Spring Boot, MySQL, Kafka~Internship~Backend Intern at Example Bank~"
    "- Ported batch jobs to Spring Boot; load balancing and logging.~Certifications~{text}",
    # thin wrapper
    "Lena Ortiz~lena.ortiz{k}@example.org~github.com/features~Skills: Python, OpenAI API, LangChain~Projects~Quip Bot~"
    "Bot that sends each question to the OpenAI API and prints the answer.~Publications~{text}",
    # tutorials only
    "Sam Okoro~sam.okoro@example.org~Skills~Python, Streamlit, Hugging Face~Side Projects~"
    "Movie Chat clone of a well known app~Followed along with a tutorial to call ChatGPT API from Streamlit.~"
    "Weather Page~Small page.~About~{text}",
    # classical vision
    "Yuki Tanabe~yuki@example.org~github.com/user{k}~Skills: Python, PyTorch, OpenCV, NumPy~Selected Projects~"
    "Leaf Blight Detector~Trained a CNN in PyTorch for image classification of leaves, with a clean preprocessing step and"
    " a dashboard where growers see the benchmark of each season and compare fields.~Honours~{text}",
    # full stack with models; a technologies line switches the section
    "Dara Whitfield~dara.whitfield@example.org~github.com/user{k}~Projects~Recipe Finder | 2024~"
    "React and Node.js front end over a Python LangChain service with vector database retrieval, endpoints and tool use.~"
    "Technologies: React, Next.js, FastAPI, MongoDB, Vercel~Course Planner~Express app for study plans.~"
    "Experience: Web Developer, Example Studio~- Shipped Docker images with GitHub Actions and Nginx.~{text}",
    # general terms in a skills list only
    "Uma Prasad~uma.prasad@example.org~Skills: Python, TensorFlow, machine learning, scikit-learn~Education~{text}",
    # name before a phone number, several projects with dates
    "rowan +1 (555) 010-7788 | Lisbon~rowanhale{k}@example.org~Profile~Builds things with large language models.~"
    "Key Projects~Inbox Sorter (Jan 2022)~- Fine-grained text classification with LoRA adapters and prompt engineering.~"
    "Shift Planner | Kotlin | present~Retrieval Lab~"
    "FAISS and Chroma side by side, evaluated with RAGAS on a benchmark, multi agent planner with persistent state,"
    " message queue workers and etl pipeline for customers.~Employment~Example Freight 2020~"
    "- Microservice in Python with gRPC and Redis, retries and rate limiting.~{text}",
    # names of frameworks only, name from the e-mail
    "curriculum vitae~noor.haddad7@example.org~Skills: Python, CrewAI, Haystack, DSPy, Qdrant~Experience~Analyst~{text}",
    # the text as it is
    "{text}",
]


def _literal(text: str) -> str:
    return "'" + text + "'"


def _case(expression: str, values: list[str], otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expression} {arms}" + (f" ELSE {otherwise}" if otherwise else "") + " END"


_TEMPLATE = _case(f"n_chars % {len(PROFILES)}", [_literal(p) for p in PROFILES])

FILE_NAMES = ["resume_{k}_final.txt", "cv-{k}.md", "{s}_candidate_updated.txt", "notes.{k}.txt"]
_NAME = _case("doc_id % 4", [_literal(n) for n in FILE_NAMES])

APPLICATIONS = f"""
SELECT doc_id,
       concat('inbox/', source, '/', doc_id, '/', filename) AS source_file,
       filename,
       replace(replace(replace(template, '~', chr(10)), '{{k}}', concat('', n_chars % 170)), '{{text}}', text) AS text
FROM (
  SELECT doc_id, source, n_chars, text, {_TEMPLATE} AS template,
         replace(replace({_NAME}, '{{k}}', concat('', doc_id % 50)), '{{s}}', lang) AS filename
  FROM documents
) AS composed
"""

# documents as files: some with an unsupported extension, some unreadable, some blank
RAW_FILES = """
SELECT doc_id, source_file, filename,
       CASE WHEN n_chars % 17 = 3 THEN '.png' ELSE '.txt' END AS extension,
       CASE WHEN n_chars % 19 = 4 THEN 'ValueError: broken' END AS error,
       CASE WHEN n_chars % 13 = 5 THEN concat(chr(10), ' ', chr(9), chr(10)) ELSE raw END AS raw_text
FROM (
  SELECT doc_id, n_chars, concat('drop/', source, '/', doc_id, '.txt') AS source_file,
         concat(doc_id, '.txt') AS filename,
         replace(text, '. ', concat('.  (cid:7)', chr(13), chr(10), chr(10), '   ', chr(10), chr(9))) AS raw
  FROM documents
) AS files
"""

# two readings of every document; the second one has lost or gained separators
EXTRACTIONS = """
SELECT doc_id, 'layout' AS extractor, 1 AS pri,
       CASE n_chars % 5 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE text END AS text,
       CASE n_chars % 5 WHEN 2 THEN 'IOError: bad page' END AS error
FROM documents
UNION ALL
SELECT doc_id, 'plain' AS extractor, 2 AS pri,
       CASE n_chars % 7 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN NULL
            WHEN 2 THEN concat(text, ' the project and the data model for users') ELSE text END AS text,
       CAST(NULL AS {string}) AS error
FROM documents
"""

ACTIVITY_PROFILES = """
SELECT concat('user', user_id) AS username,
       CASE user_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 403 ELSE 200 END AS http_status,
       CAST(user_id % 40 AS INT) AS public_repos,
       CASE user_id % 11 WHEN 2 THEN 'timeout' END AS error
FROM (SELECT DISTINCT user_id FROM events) AS users
"""

# events of some users are old, some users have none with a time
ACTIVITY_EVENTS = """
SELECT concat('user', user_id) AS username,
       CASE WHEN user_id % 10 < 8 AND event_type <> 'error'
            THEN CAST(ts AS TIMESTAMP) - INTERVAL '1' DAY * CAST((user_id % 7) * 70 AS INT) END AS created_at
FROM events
"""

ACTIVITY_REPOS = """
SELECT concat('user', o_custkey % 160) AS username,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('repo-', o_orderkey) END AS name,
       CASE o_orderkey % 6 WHEN 0 THEN 'RAG service with vector search' WHEN 1 THEN 'static site'
            WHEN 2 THEN 'multi_agent planner' WHEN 3 THEN 'storage drivers' WHEN 4 THEN NULL ELSE 'fragile parser' END AS description,
       CASE o_orderkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN NULL ELSE 'TypeScript' END AS language,
       CASE o_orderkey % 3 WHEN 0 THEN {array_open}'llm', 'tools'{array_close} WHEN 1 THEN {array_open}'web'{array_close} END AS topics,
       o_orderstatus = 'P' AS fork,
       CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8218' DAY AS pushed_at
FROM orders
"""

_PROJECT = (
    '{{"name":" Judged {k} ","description":" Agent service with retrieval and {w} ",'
    '"technologies":["LangGraph"," Python ","","LangGraph"],"domain":"{domain}",'
    '"signals":{{"retrieval":true,"tool_use":{flag}}},"quality_score":{score},'
    '"quality_rationale":"{why}","cited_evidence":"","is_thin_wrapper":{thin},"is_tutorial":false}}'
)


def _project(domain="ai_agentic", score="{score}", flag="true", why="Cites retrieval.", thin="false") -> str:
    return _PROJECT.format(k="{k}", w="{w}", domain=domain, score=score, flag=flag, why=why, thin=thin)


RESPONSES_TEXT = [
    '{"projects":[' + _project() + "]}",
    "```json~{\"projects\":[" + _project(why="") + "," + _project(domain="data", score="9") + "]}~```",
    '{"projects":[]}',
    "{}",
    "not json",
    '["projects"]',
    '{"projects":[' + _project(score="10.5") + "]}",
    '{"projects":[' + _project(domain="blockchain") + "]}",
    '{"projects":[{"name":"No description"}]}',
    '{"projects":[' + _project(score="2", flag="false", thin="true") + "," + _project(domain="ai_general") + "]}",
    '{"projects":[{"name":"Plain","description":"Only the required members"}]}',
    '{"projects":[{"name":null,"description":"x"}]}',
    "",
]

RESPONSES = f"""
SELECT doc_id,
       replace(replace(replace(replace(template, '~', chr(10)), '{{k}}', concat('', n_chars % 9)),
               '{{score}}', concat('', CAST(floor((n_chars % 100) / 10) AS BIGINT), '.', n_chars % 10)),
               '{{w}}', lang) AS response
FROM (
  SELECT doc_id, n_chars, lang,
         {_case(f"(n_chars + doc_id) % {len(RESPONSES_TEXT)}", [_literal(r) for r in RESPONSES_TEXT])} AS template
  FROM documents
) AS composed
"""

EXTRACTION_TEXT = [
    '{"candidate_name":" Given Name ","skills":["Python"," Rust ",""],"projects":[],"experience_highlights":[]}',
    '{"candidate_name":"One Two Three Four Five Six","skills":["Zig"],"projects":[' + _project() + '],"experience_highlights":["Led a team"]}',
    '{"candidate_name":"Agent 47","skills":[]}',
    '{"skills":"Python"}',
    "broken",
    '{"candidate_name":5}',
]

EXTRACTION_RESPONSES = f"""
SELECT doc_id,
       replace(replace(replace(template, '{{k}}', concat('', n_chars % 9)),
               '{{score}}', concat('', CAST(floor((n_chars % 100) / 10) AS BIGINT), '.', n_chars % 10)),
               '{{w}}', lang) AS response
FROM (
  SELECT doc_id, n_chars, lang,
         {_case(f"(n_chars + doc_id) % {len(EXTRACTION_TEXT)}", [_literal(r) for r in EXTRACTION_TEXT])} AS template
  FROM documents
) AS composed
"""

# words that occur in the given documents
PLAIN_VOCABULARY = {
    "license": {"Apache License": ["apache license", "apache"], "MIT": ["mit license", "mit"], "License": ["license", "licensed"]},
    "words": {"Token": ["token", "tokens", "api token"], "And The": ["and the", "of the"], "E-mail": ["e-mail", "mail", "email"],
              "In It": ["in it"], "For": ["for"]},
    "mixed": {"Render": ["render", "render.com"], "Dotted": ["example.com", "www.example"], "Tion": ["tion"],
              "Key": ["api_key", "secret", "password"]},
}


def spark_sql(statement: str) -> str:
    return _dialect(statement, string="STRING", array_open="array(", array_close=")")


def duckdb_sql(statement: str) -> str:
    return _dialect(statement, string="VARCHAR", array_open="[", array_close="]")


def _dialect(statement: str, **words: str) -> str:
    for name, value in words.items():
        statement = statement.replace("{" + name + "}", value)
    return statement
