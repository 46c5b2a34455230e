"""Plain SQL for DuckDB that answers the checked queries in another way.

Joins to the vocabulary are nested loops here, sections come from a window, projects
from a running sum. Only parameters (word lists, weights, patterns without lookaround)
are shared with the Spark side.
"""

from __future__ import annotations

from evisift.functions.text import BREAK_CLASS, COMMON_WORDS, SPACE_CHARS, SPACE_CLASS, any_of, escape
from evisift.operators import activity as act
from evisift.operators import fields as fld
from evisift.operators import judgements as jud
from evisift.operators import projects as prj
from evisift.operators import sections as sec
from evisift.params import SOURCE_TENTHS
from evisift.vocabulary import CLOUD_FULLSTACK_TENTHS, PYTHON_BACKEND_TENTHS, Vocabulary
from evisift_checks import corpus

STANDARD = Vocabulary.standard()
PLAIN = Vocabulary.of(corpus.PLAIN_VOCABULARY)

WS = "'" + SPACE_CHARS + "'"
NL = "chr(10)"
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def quoted(values) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


def values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE_CLASS}]+'))"


def squeeze(x: str) -> str:
    return f"regexp_replace({trim(x)}, '[{SPACE_CLASS}]+', ' ', 'g')"


def half_up(n: str, d) -> str:
    return f"((2 * ({n}) + ({d})) // (2 * ({d})))"


def tenths(x: str) -> str:
    return f"concat(({x}) // 10, '.', ({x}) % 10)"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
        f"regexp_matches({x}[i - 1], '\\p{{L}}') THEN upper({x}[i]) ELSE lower({x}[i]) END), '')"
    )


def bounded(form: str) -> str:
    body = escape(form).replace(" ", f"[{SPACE_CLASS}_\\-]+")
    return f"(?:^|[^a-z0-9]){body}(?:$|[^a-z0-9])"


def vocab_rows(vocab: Vocabulary):
    return [
        (e.grp, e.grp_ord, e.canonical, e.ord, e.surface, e.surface.split(" ")[0], bounded(e.surface), e.tier)
        for e in vocab.entries
    ]


def found(body: str) -> str:
    return (
        f"CASE WHEN contains(lower({body}), v.head) THEN regexp_matches(lower({body}), v.pattern) ELSE false END"
    )


VOCAB_COLUMNS = "(grp, grp_ord, canonical, ord, surface, head, pattern, tier)"
TERM_ORD = "(v.grp_ord * 100000 + v.ord)"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (list(needs), sql)


def query(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select


def clean_ctes(prefix: str, source: str, keep: str, text: str) -> None:
    """``{prefix}_parts`` and ``{prefix}`` with a cleaned ``text``."""
    flat = f"regexp_replace({text}, '\\(cid:\\p{{Nd}}+\\)|\\x00', ' ', 'g')"
    flat = f"regexp_replace({flat}, '\\r\\n|[{BREAK_CLASS}]', {NL}, 'g')"
    cte(f"{prefix}_parts", f"""
        SELECT {keep}, {text} AS raw_text,
               list_transform(string_split({flat}, {NL}), lambda x: {trim('x')}) AS l FROM {source}""", source)
    cte(prefix, f"""
        SELECT {keep}, raw_text,
               {trim(f"array_to_string(list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> ''), {NL})")} AS text
        FROM {prefix}_parts""", f"{prefix}_parts")


cte("docs", "SELECT doc_id, text FROM documents")
cte("apps_raw", corpus.duckdb_sql(corpus.APPLICATIONS))
clean_ctes("apps", "apps_raw", "doc_id, source_file, filename", "text")
clean_ctes("clean_docs", "docs", "doc_id", "text")
cte("raw_files", corpus.duckdb_sql(corpus.RAW_FILES))
clean_ctes("clean_files", "raw_files", "doc_id, source_file, filename, extension, error", "raw_text")
cte("vocab", f"SELECT * FROM ({values(vocab_rows(STANDARD))}) AS t{VOCAB_COLUMNS}")
cte("plain_vocab", f"SELECT * FROM ({values(vocab_rows(PLAIN))}) AS t{VOCAB_COLUMNS}")
cte("aliases", "SELECT * FROM (" + values([
    (s, i, a) for i, (s, names) in enumerate(sec.SECTION_ALIASES.items()) for a in names
]) + ") AS t(section, section_ord, alias)")
cte("sources", f"SELECT * FROM ({values(sec.SECTION_SOURCE.items())}) AS t(section, source)")
cte("multipliers", f"SELECT * FROM ({values(SOURCE_TENTHS.items())}) AS t(source, tenths)")
cte("weights", "SELECT * FROM (" + values(
    [("python_backend", t, w) for t, w in PYTHON_BACKEND_TENTHS.items()]
    + [("cloud_fullstack", t, w) for t, w in CLOUD_FULLSTACK_TENTHS.items()]
) + ") AS t(category, term, weight)")

# ---- lines and sections ---------------------------------------------------
cte("app_lines", f"""
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, l[line_no + 1] AS line
    FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM apps WHERE text <> '') AS a,
         unnest(range(len(l))) AS t(line_no)""", "apps")
INLINE = sec.INLINE_HEADING
NORM = (
    f"regexp_replace(trim(lower(x), '{sec.HEADING_TRIM}'), '[{SPACE_CLASS}]+', ' ', 'g')"
)
cte("probes", f"""
    SELECT doc_id, line_no, which, x, {NORM} AS norm FROM (
      SELECT doc_id, line_no, 'own' AS which, {trim('line')} AS x FROM app_lines
      UNION ALL
      SELECT doc_id, line_no, 'inline', {trim(f"regexp_extract({trim('line')}, '{INLINE}', 1)")} FROM app_lines
    ) AS p""", "app_lines")
cte("opened", f"""
    SELECT p.doc_id, p.line_no, p.which, arg_min(a.section, a.section_ord) AS section
    FROM probes AS p JOIN aliases AS a
      ON p.norm = a.alias OR starts_with(p.norm, a.alias || ' ') OR p.norm = a.alias || 's'
    WHERE length(p.x) BETWEEN 1 AND 60 AND NOT (ends_with(p.x, '.') AND {words('p.x')} > 3)
    GROUP BY ALL""", "probes", "aliases")
cte("marks", f"""
    SELECT l.doc_id, l.line_no, l.line, coalesce(i.section, o.section) AS section, i.section AS inline_section,
           o.section AS own_section,
           CASE WHEN i.section IS NOT NULL THEN {trim(f"regexp_extract({trim('l.line')}, '{INLINE}', 2)")} END AS rest
    FROM app_lines AS l
    LEFT JOIN opened AS o ON o.doc_id = l.doc_id AND o.line_no = l.line_no AND o.which = 'own'
    LEFT JOIN opened AS i ON i.doc_id = l.doc_id AND i.line_no = l.line_no AND i.which = 'inline'""",
    "app_lines", "opened")
cte("assigned", """
    SELECT doc_id, line_no, section, line FROM (
      SELECT doc_id, line_no,
             coalesce(last_value(section IGNORE NULLS) OVER (
               PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'summary') AS section,
             section AS opens, CASE WHEN section IS NULL THEN line ELSE rest END AS line
      FROM marks) AS m
    WHERE opens IS NULL OR line <> ''""", "marks")
cte("section_text", f"""
    SELECT doc_id, section, {trim(f"string_agg(line, {NL} ORDER BY line_no)")} AS section_text
    FROM assigned GROUP BY ALL""", "assigned")

# ---- terms ------------------------------------------------------------------
cte("line_hits", f"""
    SELECT DISTINCT a.doc_id, a.line_no, a.line, s.source, v.grp, v.canonical, {TERM_ORD} AS term_ord, v.tier
    FROM assigned AS a JOIN sources AS s USING (section) JOIN vocab AS v ON {found('a.line')}""",
    "assigned", "sources", "vocab")
cte("evidence", f"""
    SELECT doc_id, CASE WHEN grp IN ('python', 'ai') THEN grp ELSE 'other' END AS evidence_group,
           canonical AS term, source, left({trim('line')}, 140) AS context,
           min(line_no) AS line_no, CAST(min(term_ord) AS INTEGER) AS term_ord
    FROM line_hits GROUP BY ALL""", "line_hits")
cte("text_hits", f"""
    SELECT DISTINCT a.doc_id, v.grp, v.canonical, {TERM_ORD} AS term_ord, v.tier
    FROM apps AS a JOIN vocab AS v ON {found('a.text')}""", "apps", "vocab")
cte("app_skills", """
    SELECT doc_id, list(canonical ORDER BY term_ord) AS skills
    FROM (SELECT doc_id, canonical, min(term_ord) AS term_ord FROM text_hits GROUP BY ALL) AS t GROUP BY doc_id""",
    "text_hits")

# ---- contact fields ------------------------------------------------------------
EMAIL_SQL = f"nullif(regexp_extract(text, '{fld.EMAIL}'), '')"
HANDLE_SQL = f"regexp_extract(text, '{fld.HANDLE}', 1)"
cte("contacts", f"""
    SELECT doc_id, filename, {EMAIL_SQL} AS email,
           CASE WHEN {HANDLE_SQL} <> '' AND lower({HANDLE_SQL}) NOT IN ({quoted(fld.RESERVED_HANDLES)})
                THEN {HANDLE_SQL} END AS username FROM apps""", "apps")
ROLE_ALT = "|".join(fld.ROLE_WORDS)
cte("name_lines", f"""
    SELECT l.doc_id, l.line_no, {trim('l.line')} AS line
    FROM app_lines AS l JOIN marks AS m USING (doc_id, line_no)
    WHERE l.line_no < 15 AND m.own_section IS NULL
      AND regexp_full_match({trim('l.line')}, '[A-Za-z][A-Za-z.\\-'' ]*')
      AND {words('l.line')} BETWEEN 2 AND 4
      AND NOT regexp_matches(lower(l.line), 'http|{'|'.join(fld.NOT_IN_NAME)}')
      AND {trim('l.line')} <> lower({trim('l.line')})
      AND NOT regexp_matches(lower(l.line), '(?:^|[^a-z])(?:{ROLE_ALT})(?:$|[^a-z])')""", "app_lines", "marks")
cte("free_names", f"""
    SELECT doc_id, arg_min(line, line_no) AS name FROM name_lines AS n
    WHERE NOT EXISTS (SELECT 1 FROM vocab AS v WHERE {found('n.line')}) GROUP BY doc_id""", "name_lines", "vocab")
cte("phone_names", f"""
    SELECT doc_id, arg_min(first, line_no) AS first FROM (
      SELECT doc_id, line_no, regexp_extract(line, '{fld.PHONE_LINE.replace("'", "''")}', 1) AS first
      FROM app_lines WHERE line_no < 6) AS p
    WHERE first <> '' AND lower(first) NOT IN ({quoted(fld.ROLE_WORDS)}) GROUP BY doc_id""", "app_lines")
STEM = r"regexp_replace(filename, '(.)\.[^.]+$', '\1')"
NOISE = fld.STEM_NOISE
cte("name_parts", f"""
    SELECT c.doc_id, f.name, p.first, c.email,
           regexp_replace(lower(split_part(c.email, '@', 1)), '[0-9]+', '', 'g') AS local,
           list_filter(regexp_split_to_array(split_part(c.email, '@', 1), '[._\\-]+|[0-9]+'), lambda t: length(t) >= 2) AS parts,
           {squeeze(f"regexp_replace(regexp_replace({STEM}, '[_\\-]+', ' ', 'g'), '{NOISE}', '', 'g')")} AS stem
    FROM contacts AS c LEFT JOIN free_names AS f USING (doc_id) LEFT JOIN phone_names AS p USING (doc_id)""",
    "contacts", "free_names", "phone_names")
cte("surnames", """
    SELECT *, CASE WHEN starts_with(local, lower(first)) AND length(local) > length(first) + 1
                   THEN substr(local, length(first) + 1) END AS surname FROM name_parts""", "name_parts")
cte("app_names", f"""
    SELECT doc_id, coalesce(
      name,
      CASE WHEN first IS NOT NULL AND regexp_full_match(surname, '[a-z]+')
           THEN concat({title('first')}, ' ', {title('surname')}) ELSE {title('first')} END,
      CASE WHEN email IS NOT NULL AND len(parts) >= 2
           THEN array_to_string(list_transform(parts, lambda t: {title('t')}), ' ') END,
      CASE WHEN stem <> '' THEN {title('stem')} ELSE '{fld.UNKNOWN_NAME}' END) AS candidate_name
    FROM surnames""", "surnames")

# ---- projects ------------------------------------------------------------------
S = trim("line")
IS_TITLE = f"""(
    {S} <> '' AND NOT regexp_matches({S}, '^{any_of(prj.BULLETS)}') AND NOT ends_with({S}, '.')
    AND CASE WHEN contains({S}, '|') OR regexp_matches({S}, '{prj.DATE}') THEN length({S}) <= {prj.LONG_TITLE}
             ELSE length({S}) <= {prj.SHORT_TITLE} AND {words('line')} <= {prj.TITLE_WORDS} END)"""
cte("project_lines", f"""
    SELECT doc_id, line_no, line, CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS project_no
    FROM (SELECT doc_id, line_no, line,
                 CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 OR {IS_TITLE} THEN 1 ELSE 0 END AS starts
          FROM assigned WHERE section = 'projects' AND {S} <> '') AS p""", "assigned")
cte("blocks", f"""
    SELECT doc_id, project_no, list(line ORDER BY line_no) AS l FROM project_lines GROUP BY ALL""", "project_lines")
cte("project_texts", f"""
    SELECT doc_id, project_no, left({trim("split_part(head, '|', 1)")}, 120) AS name,
           left(CASE WHEN rest <> '' THEN rest ELSE tail END, 1200) AS description, body
    FROM (SELECT doc_id, project_no, {trim('l[1]')} AS head, {trim(f"array_to_string(l[2:], {NL})")} AS rest,
                 CASE WHEN contains(l[1], '|') THEN {trim("substr(l[1], instr(l[1], '|') + 1)")} ELSE '' END AS tail,
                 array_to_string(l, {NL}) AS body FROM blocks) AS b""", "blocks")
cte("project_hits", f"""
    SELECT DISTINCT p.doc_id, p.project_no, v.grp, v.canonical, v.tier
    FROM project_texts AS p JOIN vocab AS v ON {found('p.body')}""", "project_texts", "vocab")
DOMAIN = f"""CASE WHEN bool_or(h.tier = 'core') THEN 'ai_agentic' WHEN bool_or(h.grp = 'ai') THEN 'ai_general'
    WHEN bool_or(h.canonical IN ({quoted(prj.WEB_TERMS)})) THEN 'web_fullstack'
    WHEN bool_or(h.canonical IN ({quoted(prj.DATA_TERMS)})) THEN 'data'
    WHEN count(h.canonical) > 0 THEN 'other' ELSE 'unknown' END"""
cte("app_projects", f"""
    SELECT p.doc_id, p.project_no, any_value(p.name) AS name, any_value(p.description) AS description,
           coalesce(list_sort(list_distinct(list(h.canonical) FILTER (h.canonical IS NOT NULL))), CAST([] AS VARCHAR[])) AS technologies,
           {DOMAIN} AS domain
    FROM project_texts AS p LEFT JOIN project_hits AS h USING (doc_id, project_no) GROUP BY ALL""",
    "project_texts", "project_hits")
# the shape shared by projects found in the text and judged ones
SIGNAL_NAMES = [s.name for s in prj.SIGNALS]
cte("rough_projects", f"""
    SELECT doc_id, project_no, name, description, technologies, domain, CAST(NULL AS DOUBLE) AS quality_score,
           CAST(NULL AS VARCHAR) AS quality_rationale, false AS is_thin_wrapper, false AS is_tutorial,
           {", ".join(f"CAST(NULL AS BOOLEAN) AS j_{s}" for s in SIGNAL_NAMES)}
    FROM app_projects""", "app_projects")


def phrases(x: str, forms) -> str:
    return " OR ".join(f"contains(lower({x}), '{p}')" for p in forms)


def signal_sql(s: prj.Signal) -> str:
    own = phrases("any_value(t.told)", s.phrases)
    if s.terms:
        own += f" OR coalesce(bool_or(v.canonical IN ({quoted(s.terms)}) AND v.grp IN ({quoted(s.groups)})), false)"
    return f"({own})"


def grade_ctes(prefix: str, source: str) -> None:
    """Grade the AI projects of ``source``."""
    cte(f"{prefix}_told", f"""
        SELECT *, concat_ws(' ', name, description, array_to_string(technologies, ' ')) AS told
        FROM {source} WHERE domain IN ({quoted(prj.AI_DOMAINS)})""", source)
    cte(f"{prefix}_signals", f"""
        SELECT t.doc_id, t.project_no, {", ".join(f"{signal_sql(s)} AS d_{s.name}" for s in prj.SIGNALS)},
               coalesce(bool_or(v.grp = 'ai' AND v.canonical IN ({quoted(prj.MODEL_TERMS)})), false) AS mentions_model
        FROM {prefix}_told AS t LEFT JOIN vocab AS v ON {found('t.told')} GROUP BY ALL""", f"{prefix}_told", "vocab")
    picked = ", ".join(
        f"CASE WHEN t.quality_score IS NOT NULL THEN t.j_{s} ELSE g.d_{s} END AS {s}" for s in SIGNAL_NAMES
    )
    cte(f"{prefix}_picked", f"""
        SELECT t.doc_id, t.project_no, t.name, t.description, t.domain, t.quality_score, t.quality_rationale,
               t.is_thin_wrapper, t.is_tutorial, g.mentions_model, {picked}
        FROM {prefix}_told AS t JOIN {prefix}_signals AS g USING (doc_id, project_no)""",
        f"{prefix}_told", f"{prefix}_signals")
    flow = " OR ".join(s.name for s in prj.SIGNALS if s.workflow)
    score = " + ".join(f"CASE WHEN {s.name} THEN {s.weight} ELSE 0 END" for s in prj.SIGNALS)
    count = " + ".join(f"CAST({s} AS INTEGER)" for s in SIGNAL_NAMES)
    told = "lower(concat_ws(' ', name, description))"
    cte(f"{prefix}_graded", f"""
        SELECT *, CASE WHEN quality_score IS NOT NULL THEN CAST(round(quality_score * 10000) AS BIGINT)
                       ELSE 100 * least(200 + {score}, CASE WHEN {flow} THEN 1000 ELSE 300 END) END AS quality,
               CAST({count} AS INTEGER) AS signal_count,
               is_thin_wrapper OR (mentions_model AND NOT ({flow})) AS thin,
               CASE WHEN is_tutorial THEN 'tutorial/boilerplate'
                    WHEN {phrases(told, prj.TUTORIAL_MARKERS)} THEN 'tutorial-style'
                    WHEN {words('description')} < 15 THEN 'listed without implementation detail' END AS tutorial_label,
               CASE WHEN name <> '' THEN name ELSE 'untitled' END AS shown
        FROM {prefix}_picked""", f"{prefix}_picked")
    thin = "(150000 - least(100000, greatest(0, quality)))"
    cte(f"{prefix}_docs", f"""
        SELECT doc_id, max(quality) AS best, count(*) FILTER (quality > 30000) AS solid, max(signal_count) AS best_signals,
               list(concat(shown, ': depth ', {tenths(half_up('quality', 1000))}, '/10',
                           coalesce(' — ' || quality_rationale, '')) ORDER BY project_no) AS project_reasons,
               sum(CASE WHEN thin THEN {thin} ELSE 0 END + CASE WHEN tutorial_label IS NOT NULL THEN 30000 ELSE 0 END) AS taken,
               flatten(list(list_filter([
                 CASE WHEN thin THEN concat('Thin LLM/API wrapper, no meaningful workflow: ', shown, ' (-',
                                            {tenths(half_up(thin, 1000))}, ')') END,
                 CASE WHEN tutorial_label IS NOT NULL THEN concat(tutorial_label, ': ', shown, ' (-3.0)') END
               ], lambda x: x IS NOT NULL) ORDER BY project_no)) AS penalty_told
        FROM {prefix}_graded GROUP BY doc_id""", f"{prefix}_graded")


grade_ctes("rough", "rough_projects")

# ---- gate -------------------------------------------------------------------
cte("flags", """
    SELECT doc_id, bool_or(grp = 'python') AS has_python, coalesce(bool_or(tier = 'core'), false) AS has_core,
           coalesce(bool_or(tier = 'general' AND source IN ('project', 'experience')), false) AS has_general_project
    FROM line_hits GROUP BY doc_id""", "line_hits")
cte("app_gate", """
    SELECT *, has_text AND has_python AND has_ai AS eligible,
           list_filter([CASE WHEN NOT has_text THEN 'No extractable resume text' END,
                        CASE WHEN NOT has_python THEN 'No evidence of Python stack' END,
                        CASE WHEN NOT has_ai THEN 'No AI/agentic project evidence' END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT a.doc_id, a.text <> '' AS has_text, coalesce(f.has_python, false) AS has_python,
                 coalesce(f.has_core, false) AS has_core, coalesce(f.has_general_project, false) AS has_general_project,
                 coalesce(f.has_core OR f.has_general_project, false) AS has_ai
          FROM apps AS a LEFT JOIN flags AS f USING (doc_id)) AS g""", "apps", "flags")

# ---- weighted categories ----------------------------------------------------------
cte("best_mentions", """
    SELECT doc_id, term, max(tenths) AS best_tenths,
           min((CASE WHEN evidence_group = 'python' THEN 0 ELSE 1 END) * 1000000000000000 + CAST(line_no AS BIGINT) * 10000000 + term_ord) AS python_at,
           min((CASE WHEN evidence_group = 'python' THEN 1 ELSE 0 END) * 1000000000000000 + CAST(line_no AS BIGINT) * 10000000 + term_ord) AS other_at
    FROM evidence JOIN multipliers USING (source) WHERE evidence_group <> 'ai' GROUP BY ALL""", "evidence", "multipliers")
WHERE = """CASE WHEN best_tenths >= 10 THEN 'project' WHEN best_tenths >= 9 THEN 'experience'
    WHEN best_tenths <= 4 THEN 'skills (list-only)' ELSE 'context' END"""
cte("weighted", f"""
    SELECT doc_id, category, CAST(s AS BIGINT) AS weighted_sum, terms,
           CAST(CASE WHEN category = 'python_backend' THEN least(3000, {half_up('s * 300', 70)})
                     ELSE least(1500, {half_up('s * 150', 40)}) END AS BIGINT) AS points_hundredths
    FROM (SELECT doc_id, category, sum(weight * best_tenths) AS s,
                 list(concat(term, ' (', {WHERE}, ')')
                      ORDER BY CASE WHEN category = 'python_backend' THEN python_at ELSE other_at END) AS terms
          FROM best_mentions JOIN weights USING (term) GROUP BY ALL) AS w""", "best_mentions", "weights")
ENGINEERING = quoted(STANDARD.names("engineering"))
cte("engineering", f"""
    SELECT doc_id, list_sort(list_distinct(list(term))) AS terms FROM evidence
    WHERE evidence_group = 'other' AND term IN ({ENGINEERING}) GROUP BY doc_id""", "evidence")
cte("core_terms", """
    SELECT doc_id, list_sort(list_distinct(list(canonical))) AS terms FROM line_hits WHERE tier = 'core' GROUP BY doc_id""",
    "line_hits")

# ---- activity ----------------------------------------------------------------
cte("profiles", corpus.duckdb_sql(corpus.ACTIVITY_PROFILES))
cte("user_events", corpus.duckdb_sql(corpus.ACTIVITY_EVENTS))
cte("user_repos", corpus.duckdb_sql(corpus.ACTIVITY_REPOS))


def days(ts: str) -> str:
    return f"greatest(0, CAST(floor((epoch_us({AS_OF}) - epoch_us({ts})) / 86400000000.0) AS INTEGER))"


cte("event_sums", f"""
    SELECT username, max(created_at) AS newest_event,
           count(*) FILTER ({days('created_at')} <= 90 AND created_at IS NOT NULL) AS recent_events
    FROM user_events GROUP BY username""", "user_events")
CORE = quoted(STANDARD.names("ai", "core"))
cte("repo_flags", f"""
    SELECT username, coalesce(name, 'unnamed') AS repo, pushed_at, active,
           active AND (coalesce(language = 'Python', false) OR EXISTS (
             SELECT 1 FROM vocab AS v WHERE v.grp = 'ai' AND v.tier = 'core' AND {found('told')})) AS relevant
    FROM (SELECT *, coalesce(NOT fork AND {days('pushed_at')} <= 180, false) AS active,
                 concat_ws(' ', coalesce(name, ''), coalesce(description, ''),
                           array_to_string(coalesce(topics, CAST([] AS VARCHAR[])), ' ')) AS told
          FROM user_repos) AS r""", "user_repos", "vocab")
cte("repo_sums", """
    SELECT username, max(pushed_at) AS newest_push, count(*) FILTER (active) AS active_repos,
           count(*) FILTER (relevant) AS relevant_count,
           coalesce((list(repo ORDER BY pushed_at DESC, repo) FILTER (relevant))[1:10], CAST([] AS VARCHAR[])) AS relevant_repos
    FROM repo_flags GROUP BY username""", "repo_flags")
cte("activity_base", f"""
    SELECT p.username, p.public_repos, p.http_status, p.error,
           CASE WHEN http_status = 200 THEN 'ok' WHEN http_status = 404 THEN 'not_found'
                WHEN http_status IN (403, 429) THEN 'rate_limited' ELSE 'error' END AS status,
           {days('coalesce(e.newest_event, r.newest_push)')} AS any_days,
           coalesce(e.newest_event, r.newest_push) IS NULL AS no_date,
           coalesce(e.recent_events, 0) AS recent, coalesce(r.active_repos, 0) AS active_repos,
           coalesce(r.relevant_count, 0) AS relevant_count, coalesce(r.relevant_repos, CAST([] AS VARCHAR[])) AS named
    FROM profiles AS p LEFT JOIN event_sums AS e USING (username) LEFT JOIN repo_sums AS r USING (username)""",
    "profiles", "event_sums", "repo_sums")
cte("activity", """
    SELECT username, status,
           CASE status WHEN 'not_found' THEN 'GitHub profile not found' WHEN 'rate_limited' THEN 'GitHub API rate limited'
                WHEN 'error' THEN 'GitHub profile unavailable'
                ELSE concat_ws('; ', CASE WHEN no_date THEN 'no recent public activity' ELSE concat('last public activity ~', any_days, 'd ago') END,
                               CASE WHEN recent > 0 THEN concat(recent, ' event(s) in 90d') END,
                               CASE WHEN len(named) > 0 THEN concat('relevant repos: ', array_to_string(named[1:3], ', ')) END) END AS activity_summary,
           CAST(CASE WHEN status <> 'ok' OR no_date THEN 0 ELSE least(500,
             CASE WHEN any_days <= 30 THEN 400 WHEN any_days <= 90 THEN 300 WHEN any_days <= 180 THEN 200
                  WHEN any_days <= 365 THEN 100 ELSE 50 END
             + CASE WHEN recent >= 5 THEN 100 WHEN recent >= 2 THEN 50 ELSE 0 END) END AS BIGINT) AS activity_h,
           CAST(CASE WHEN status = 'ok' THEN least(500, active_repos * 80 + relevant_count * 120) ELSE 0 END AS BIGINT) AS repo_h,
           CASE WHEN status = 'ok' THEN public_repos END AS public_repos,
           CASE WHEN status = 'ok' AND NOT no_date THEN any_days END AS days_since_last_activity,
           CASE WHEN status = 'ok' THEN named ELSE CAST([] AS VARCHAR[]) END AS relevant_repos,
           CASE WHEN status <> 'ok' THEN coalesce(error, CASE WHEN status = 'error' THEN concat('status ', http_status) END) END AS error,
           status IN ('rate_limited', 'error') AS flagged
    FROM activity_base""", "activity_base")

# ---- judgements -----------------------------------------------------------------
cte("responses", corpus.duckdb_sql(corpus.RESPONSES))
cte("extraction_responses", corpus.duckdb_sql(corpus.EXTRACTION_RESPONSES))


def response_ctes(prefix: str, source: str, stage: str, more: str = "true") -> None:
    text = trim("response")
    fenced = f"regexp_replace(string_split({text}, '```')[2], '^json', '')"
    cte(f"{prefix}_json", f"""
        SELECT doc_id, response, TRY_CAST(CASE WHEN starts_with({text}, '```') THEN {trim(fenced)} ELSE {text} END AS JSON) AS j
        FROM {source}""", source)
    cte(f"{prefix}_typed", f"""
        SELECT *, CASE WHEN response = '' THEN 'empty response from model'
                       WHEN j IS NULL THEN 'response was not valid JSON'
                       WHEN json_type(j) <> 'OBJECT' THEN 'expected a JSON object at the top level' END AS failure
        FROM {prefix}_json""", f"{prefix}_json")
    def kind(name):
        return f"coalesce(json_type(p, '$.{name}'), 'ABSENT')"
    flags = [f"signals.{s}" for s in SIGNAL_NAMES] + ["is_thin_wrapper", "is_tutorial"]
    checks = [
        f"{kind('name')} = 'VARCHAR'", f"{kind('description')} = 'VARCHAR'",
        f"{kind('technologies')} IN ('ABSENT', 'ARRAY')",
        f"({kind('domain')} = 'ABSENT' OR coalesce(p->>'$.domain', '') IN ({quoted(prj.DOMAINS)}))",
        f"({kind('quality_score')} = 'ABSENT' OR coalesce(TRY_CAST(p->>'$.quality_score' AS DOUBLE) BETWEEN 0 AND 10, false))",
        f"{kind('quality_rationale')} IN ('ABSENT', 'VARCHAR')", f"{kind('cited_evidence')} IN ('ABSENT', 'VARCHAR')",
        f"{kind('signals')} IN ('ABSENT', 'OBJECT')",
        *[f"{kind(n)} IN ('ABSENT', 'BOOLEAN')" for n in flags],
    ]
    cte(f"{prefix}_items", f"""
        SELECT t.doc_id, CAST(i AS INTEGER) AS project_no, json_extract(t.j, concat('$.projects[', i, ']')) AS p
        FROM {prefix}_typed AS t, unnest(range(CAST(coalesce(json_array_length(t.j, '$.projects'), 0) AS BIGINT))) AS u(i)
        WHERE t.failure IS NULL""", f"{prefix}_typed")
    cte(f"{prefix}_checked", f"""
        SELECT t.doc_id, t.j, t.failure,
               CASE WHEN t.failure IS NOT NULL THEN '{stage}:LLMError'
                    WHEN NOT coalesce(c.valid, true) OR NOT coalesce(json_type(t.j, '$.projects'), 'ARRAY') = 'ARRAY' OR NOT ({more})
                    THEN '{stage}:ValidationError' END AS warning,
               coalesce(c.n, 0) AS n
        FROM {prefix}_typed AS t LEFT JOIN (
          SELECT doc_id, bool_and({" AND ".join(checks)}) AS valid, count(*) AS n FROM {prefix}_items GROUP BY doc_id) AS c USING (doc_id)""",
        f"{prefix}_typed", f"{prefix}_items")
    def flag(name):
        return f"coalesce(CAST(p->>'$.{name}' AS BOOLEAN), false)"
    tech = "CAST(p->'$.technologies' AS VARCHAR[])"
    cte(f"{prefix}_projects", f"""
        SELECT i.doc_id, i.project_no, left({trim("p->>'$.name'")}, 120) AS name, left({trim("p->>'$.description'")}, 1500) AS description,
               coalesce(list_sort(list_distinct(list_filter(list_transform({tech}, lambda t: {trim('t')}), lambda t: t <> ''))), CAST([] AS VARCHAR[])) AS technologies,
               coalesce(p->>'$.domain', 'unknown') AS domain, coalesce(CAST(p->>'$.quality_score' AS DOUBLE), 0.0) AS quality_score,
               nullif(p->>'$.quality_rationale', '') AS quality_rationale, {flag('is_thin_wrapper')} AS is_thin_wrapper,
               {flag('is_tutorial')} AS is_tutorial, {", ".join(f"{flag('signals.' + s)} AS j_{s}" for s in SIGNAL_NAMES)}
        FROM {prefix}_items AS i JOIN {prefix}_checked AS c USING (doc_id) WHERE c.warning IS NULL""",
        f"{prefix}_items", f"{prefix}_checked")


response_ctes("judged", "responses", "llm_scoring_failed")
response_ctes(
    "given", "extraction_responses", "llm_extraction_failed",
    "coalesce(json_type(t.j, '$.skills'), 'ARRAY') = 'ARRAY' AND coalesce(json_type(t.j, '$.candidate_name'), 'VARCHAR') = 'VARCHAR' "
    "AND coalesce(json_type(t.j, '$.experience_highlights'), 'ARRAY') = 'ARRAY'",
)
PROJECT_COLUMNS = (
    "doc_id, project_no, name, description, technologies, domain, quality_score, quality_rationale, "
    "is_thin_wrapper, is_tutorial, " + ", ".join(f"j_{s}" for s in SIGNAL_NAMES)
)
cte("refined_projects", f"""
    SELECT {PROJECT_COLUMNS} FROM judged_projects
    UNION ALL
    SELECT {PROJECT_COLUMNS} FROM rough_projects AS r WHERE NOT EXISTS (SELECT 1 FROM judged_projects AS j WHERE j.doc_id = r.doc_id)""",
    "judged_projects", "rough_projects")
grade_ctes("refined", "refined_projects")

# ---- the whole run ------------------------------------------------------------------
cte("marked", f"""
    SELECT doc_id, source_file, filename, text,
           CASE WHEN place > 1 THEN 'duplicate' WHEN text = '' THEN 'empty' ELSE 'ok' END AS parse_status,
           CASE WHEN place > 1 THEN concat('duplicate of ', first_name) WHEN text = '' THEN 'no extractable text (possibly image-only/scanned)' END AS error
    FROM (SELECT *, row_number() OVER w AS place, first_value(filename) OVER w AS first_name
          FROM apps WINDOW w AS (PARTITION BY sha256(raw_text) ORDER BY string_split(source_file, '/'))) AS m""", "apps")
cte("run_gate", """
    SELECT m.*, m.parse_status = 'ok' AND g.eligible AS is_eligible,
           CASE WHEN m.parse_status = 'ok' THEN n.candidate_name ELSE m.filename END AS candidate_name,
           CASE WHEN m.parse_status = 'ok' THEN g.reasons
                ELSE [concat('Resume not processed (', m.parse_status, '): ', m.error)] END AS rejection_reasons,
           CASE WHEN m.parse_status = 'ok' THEN coalesce(s.skills, CAST([] AS VARCHAR[])) ELSE CAST([] AS VARCHAR[]) END AS skills,
           c.username AS found_username
    FROM marked AS m JOIN app_gate AS g USING (doc_id) JOIN app_names AS n USING (doc_id) JOIN contacts AS c USING (doc_id)
    LEFT JOIN app_skills AS s USING (doc_id)""", "marked", "app_gate", "app_names", "contacts", "app_skills")
cte("run_activity", f"""
    SELECT g.*,
           CASE WHEN NOT is_eligible THEN 'disabled' WHEN lookup IS NULL THEN 'no_profile' ELSE coalesce(a.status, 'error') END AS gh_status,
           CASE WHEN is_eligible THEN lookup WHEN parse_status = 'ok' THEN found_username END AS gh_username,
           CASE WHEN parse_status <> 'ok' THEN '' WHEN NOT is_eligible THEN '{act.NOT_ENRICHED_SUMMARY}'
                WHEN lookup IS NULL THEN '{act.NO_PROFILE_SUMMARY}' ELSE coalesce(a.activity_summary, 'GitHub profile unavailable') END AS gh_summary,
           coalesce(a.activity_h, 0) AS activity_h, coalesce(a.repo_h, 0) AS repo_h
    FROM (SELECT *, CASE WHEN is_eligible AND lower(found_username) NOT IN ({quoted(act.NOT_A_HANDLE)}) THEN found_username END AS lookup
          FROM run_gate) AS g LEFT JOIN activity AS a ON a.username = g.lookup""", "run_gate", "activity")
cte("run_flags", """
    SELECT *, gh_status IN ('rate_limited', 'error') AS gh_flagged,
           CASE WHEN gh_status IN ('rate_limited', 'error') AND gh_username IS NOT NULL THEN 500
                ELSE least(1000, activity_h + repo_h) END AS gh_points FROM run_activity""", "run_activity")


def text_list(terms: str, found_text: str, none: str) -> str:
    return (
        f"CASE WHEN {terms} IS NOT NULL THEN concat('{found_text}: ', array_to_string({terms}, ', ')) ELSE '{none}' END"
    )


def run_ctes(prefix: str, graded: str) -> None:
    """``{prefix}_run``: every eligible document with its scores and reasons."""
    depth_n = "best * 67200 + least(3, solid) * 480000000 + best_signals * 180000000"
    cte(f"{prefix}_run", f"""
        SELECT *, CAST(least(10000, greatest(0, ai + py + cl + gh + en - pen)) AS BIGINT) AS total FROM (
          SELECT r.doc_id, r.candidate_name, r.source_file, r.gh_status, r.gh_username, r.gh_flagged, r.activity_h + r.repo_h AS gh_score,
                 CAST(CASE WHEN d.best IS NOT NULL THEN least(4000, {half_up(depth_n, 2400000)})
                           ELSE least(1000, 200 * coalesce(len(k.terms), 0)) END AS BIGINT) AS ai,
                 coalesce(p.points_hundredths, 0) AS py, coalesce(c.points_hundredths, 0) AS cl, r.gh_points AS gh,
                 CAST(least(500, 125 * coalesce(len(e.terms), 0)) AS BIGINT) AS en,
                 CAST({half_up('least(150000, coalesce(d.taken, 0))', 100)} AS BIGINT) AS pen,
                 CASE WHEN d.best IS NOT NULL THEN list_append(d.project_reasons, concat(
                        'best-depth ', {tenths(half_up('d.best * 2800', 1000000))}, ' + breadth ', {tenths('20 * least(3, d.solid)')},
                        ' (', d.solid, ' solid project(s)) + signals ', {tenths(half_up('d.best_signals * 600', 80))}))
                      WHEN k.terms IS NOT NULL THEN [concat('AI framework(s) named but no AI project described: ', array_to_string(k.terms, ', '))]
                      ELSE ['No AI/agentic projects found'] END AS ai_reasons,
                 {text_list('p.terms', 'Python/backend evidence', 'No Python/backend evidence')} AS py_reason,
                 {text_list('c.terms', 'Cloud/deploy/full-stack evidence', 'No cloud/deployment evidence')} AS cl_reason,
                 {text_list('e.terms', 'Engineering signals', 'No engineering-depth signals found')} AS en_reason,
                 CASE WHEN r.gh_flagged AND r.gh_username IS NOT NULL
                      THEN concat('GitHub unavailable (', r.gh_status, '); tagged — neutral placeholder ', {tenths(half_up('r.gh_points', 10))}, '/10 applied')
                      ELSE concat('GitHub enrichment: ', {tenths(half_up('r.gh_points', 10))}, '/10') END AS gh_reason,
                 CASE WHEN d.doc_id IS NULL OR len(d.penalty_told) = 0 THEN ['No project-quality penalties']
                      WHEN d.taken > 150000 THEN list_append(d.penalty_told, 'Penalties capped at -15.0')
                      ELSE d.penalty_told END AS pen_reasons
          FROM run_flags AS r LEFT JOIN {graded}_docs AS d USING (doc_id)
          LEFT JOIN weighted AS p ON p.doc_id = r.doc_id AND p.category = 'python_backend'
          LEFT JOIN weighted AS c ON c.doc_id = r.doc_id AND c.category = 'cloud_fullstack'
          LEFT JOIN engineering AS e ON e.doc_id = r.doc_id LEFT JOIN core_terms AS k ON k.doc_id = r.doc_id
          WHERE r.is_eligible) AS x""", "run_flags", f"{graded}_docs", "weighted", "engineering", "core_terms")


run_ctes("baseline", "rough")
run_ctes("final", "refined")
cte("run", """
    SELECT r.*, b.total AS base_total, b.ai AS base_ai, b.pen AS base_pen, f.total, f.ai, f.py, f.cl, f.gh, f.en, f.pen,
           f.ai_reasons, f.pen_reasons, f.py_reason, f.cl_reason, f.en_reason, f.gh_reason,
           r.is_eligible AND j.doc_id IS NOT NULL AND j.warning IS NULL AS judged,
           CASE WHEN r.is_eligible THEN j.warning END AS warning
    FROM run_flags AS r LEFT JOIN baseline_run AS b USING (doc_id) LEFT JOIN final_run AS f USING (doc_id)
    LEFT JOIN judged_checked AS j USING (doc_id)""", "run_flags", "baseline_run", "final_run", "judged_checked")
cte("ranked", """
    SELECT *, row_number() OVER (ORDER BY is_eligible DESC, total DESC NULLS LAST, lower(candidate_name), source_file) AS position,
           CASE WHEN is_eligible THEN row_number() OVER (ORDER BY is_eligible DESC, total DESC NULLS LAST, lower(candidate_name), source_file) END AS rank
    FROM run""", "run")
cte("first_projects", f"""
    SELECT doc_id, arg_min(CASE WHEN name <> '' THEN name ELSE 'Untitled project' END, project_no) AS shown,
           arg_min({squeeze('description')}, project_no) AS told FROM {{source}} GROUP BY doc_id""")
for _prefix, _source in (("rough", "app_projects"), ("refined", "refined_projects")):
    cte(f"{_prefix}_summary", CTES["first_projects"][1].replace("{source}", _source), _source)
del CTES["first_projects"]
SUMMARY = """CASE WHEN s.doc_id IS NULL THEN 'No projects described.'
    WHEN s.told <> '' THEN concat(s.shown, ': ', left(s.told, 240)) ELSE s.shown END"""
COMMON = "|".join(COMMON_WORDS)
