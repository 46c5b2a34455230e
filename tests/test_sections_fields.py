from pyspark.sql import functions as F

from evisift.functions.text import clean, quality_hundredths, strip, title_case
from evisift.operators import fields, sections


def assigned(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = sections.lines(docs).collect()
    return [(r.line_no, r.section, r.line) for r in sorted(rows, key=lambda r: r.line_no)]


def test_headings_inline_and_own_line(spark):
    text = "Ada\nSkills: Python, Docker\nPROJECTS:\nThing\n## Experience ##\nWork\nStrange Heading\nmore"
    assert assigned(spark, text) == [
        (0, "summary", "Ada"), (1, "skills", "Python, Docker"), (3, "projects", "Thing"),
        (5, "experience", "Work"), (6, "experience", "Strange Heading"), (7, "experience", "more"),
    ]


def test_a_technologies_line_switches_the_section(spark):
    assert assigned(spark, "Projects\nThing\nTechnologies: React\nrest") == [
        (1, "projects", "Thing"), (2, "skills", "React"), (3, "skills", "rest")
    ]


def test_heading_rules(apply):
    lines = ["Skills", "skills:", "• Work Experience", "Experience with teams and much more here.", "Projects.",
             "Objectives", "Skillset", "About this document", "x" * 61, "Skills " + "y" * 60, "", "Tools   used"]
    assert apply(sections.heading_section, lines) == [
        "skills", "skills", "experience", None, None, "summary", None, "summary", None, None, None, "skills"
    ]


def test_empty_inline_content_and_blank_lines(spark):
    assert assigned(spark, "Skills:   \n\nx") == [(1, "skills", ""), (2, "skills", "x")]
    assert assigned(spark, "a\n") == [(0, "summary", "a")]


def test_many_headings_stay_linear(spark):
    text = "\n".join(f"Skills\nitem {i}" for i in range(5000))
    rows = assigned(spark, text)
    assert len(rows) == 5000 and rows[-1] == (9999, "skills", "item 4999")


def test_section_texts_and_contexts(spark):
    docs = spark.createDataFrame(
        [(1, "Projects\nP1\nExperience\nE1\nProjects\nP2\nEducation\nsecret"), (2, "no headings")],
        "doc_id int, text string")
    texts = {(r.doc_id, r.section): r.section_text for r in sections.section_texts(docs).collect()}
    assert texts[1, "projects"] == "P1\nP2" and texts[2, "summary"] == "no headings"
    contexts = {r.doc_id: r.context for r in sections.scoring_context(docs, 20).collect()}
    assert contexts == {1: "PROJECTS\nP1\nP2\n\nEXPERIENCE\nE1"[:20], 2: "no headings"}


def test_clean(apply):
    raw = ["a (cid:12)b\r\n  c \x0b\x00 d\t\n\n \n e \n", "  \n\t\n", "x\n\n\n\n y"]
    assert apply(clean, raw) == ["a  b\nc\nd\n\ne", "", "x\n\ny"]
    assert apply(strip, ["　a b\x1f\n"]) == ["a b"]


def test_quality(apply):
    long_token = "z" * 21
    assert apply(quality_hundredths, ["The data, the data", "12 34", f"model {long_token}", ""]) == [
        4 * 200 + 4 * 5, -100, 200 + 2 * 5 - 500, -100
    ]


def test_title_case(apply):
    assert apply(title_case, ["o'neil mc-rae", "ADA", "x2y"]) == ["O'Neil Mc-Rae", "Ada", "X2Y"]


def test_email_and_handle(apply):
    assert apply(fields.email, ["mail a.b+c@x-y.org, other@z.com", "none@", "no"]) == ["a.b+c@x-y.org", None, None]
    assert apply(fields.handle, ["see GitHub.com/some-one/repo", "github.com/features then github.com/real", "-"]) == [
        "some-one", None, None
    ]


def named(spark, vocab, text, filename="x_resume.txt"):
    docs = spark.createDataFrame([(1, filename, text)], "doc_id int, filename string, text string")
    return fields.names(docs, vocab).collect()[0].candidate_name


def test_name_rules(spark, vocab):
    assert named(spark, vocab, "Curriculum Vitae\nTECHNICAL SKILLS\nBackend Engineer\nReact Docker\nAda B. Stone\nrest") == "Ada B. Stone"
    assert named(spark, vocab, "lowercase words here\nmira +44 7000 | Town\nmirastone9@x.org") == "Mira Stone"
    assert named(spark, vocab, "mira +44 7000\nsomeone@x.org") == "Mira"
    assert named(spark, vocab, "jo.van-dam77@x.org") == "Jo Van Dam"
    assert named(spark, vocab, "x@y.org", "teo_brandt_resume_final_2.txt") == "Teo Brandt"
    assert named(spark, vocab, "", "resume-2024.pdf") == "Unknown Candidate"


def test_contact_fields_use_the_first_mention_only(spark):
    docs = spark.createDataFrame([(1, "f.txt", "github.com/about\ngithub.com/me")], "doc_id int, filename string, text string")
    row = fields.with_contact_fields(docs).select("username", F.col("email")).collect()[0]
    assert row.username is None and row.email is None
