"""Folders of files: what is listed, what fails alone, and which text is chosen."""

import os

import pytest
from plan_shape import exchanges, nodes
from pyspark.sql import functions as F

from evisift.operators.dedupe import mark_duplicates
from evisift.plans.screening import screen
from evisift.sources import files, folder


@pytest.fixture
def inbox(tmp_path):
    deep = tmp_path / "in" / "sub" / "deeper" / "deepest"
    deep.mkdir(parents=True)
    (tmp_path / "in" / "__MACOSX").mkdir()
    root = tmp_path / "in"
    texts = {
        "good.txt": "Jane Doe\nPython, RAG", "_draft.txt": "starts with an underscore", ".hidden.txt": "x", "__MACOSX/x.txt": "x",
        "copy.txt": "Jane Doe\nPython, RAG", "blank.md": "  \n\n", "skip.png": "x", "sub/_SUCCESS.txt": "in a folder",
        "sub/deeper/deepest/far.TXT": "far away", "large.txt": "x" * 5000, "bad.pdf": "%PDF-1.4 not one",
    }
    for name, text in texts.items():
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def test_names_are_listed_apart_from_contents(spark, inbox):
    named = folder.names(spark, inbox)
    assert named.columns == ["source_file", "filename", "size", "error"]
    rows = {r.source_file[len(inbox) + 1:]: r for r in named.collect()}
    assert {"good.txt", "_draft.txt", ".hidden.txt", "sub/_SUCCESS.txt", "sub/deeper/deepest/far.TXT", "skip.png"} <= set(rows)
    assert len(rows) == 11 and rows["large.txt"].size == 5000
    assert {r.filename for r in folder.names(spark, inbox, recursive=False).collect()} == {
        "good.txt", "_draft.txt", ".hidden.txt", "copy.txt", "blank.md", "skip.png", "large.txt", "bad.pdf"}


def test_a_listing_is_dealt_by_subfolder(tmp_path):
    for k in range(5):
        for j in range(3):
            (tmp_path / f"a{k}" / f"b{j}").mkdir(parents=True)
            (tmp_path / f"a{k}" / f"b{j}" / "x.txt").write_text("x")
        (tmp_path / f"a{k}" / "y.txt").write_text("y")
    reader = folder.FolderReader(str(tmp_path), True)
    parts = reader.partitions()
    assert len(parts) > 15
    seen = [row[0] for part in parts for row in reader.read(part)]
    assert len(seen) == len(set(seen)) == 20


def test_unreadable_and_oversized_files_fail_alone(spark, inbox):
    named = folder.names(spark, inbox).filter("filename IN ('good.txt', 'large.txt')")
    ghost = spark.createDataFrame([(inbox + "/ghost.pdf", "ghost.pdf", 9, None), ("/proc/self/mem", "mem.txt", 0, None)], folder.NAMES)
    rows = {r.filename: r for r in folder.with_content(named.union(ghost), max_bytes=4000).collect()}
    assert bytes(rows["good.txt"].content).startswith(b"Jane") and rows["good.txt"].error is None
    assert rows["large.txt"].content is None and rows["large.txt"].error == "file too large: 5000 bytes"
    assert rows["ghost.pdf"].error.startswith("unreadable file:") and rows["mem.txt"].error.startswith("unreadable file:")

    table = folder.with_content(named.union(ghost), 4000).withColumn("extension", files.extension(F.col("filename")))
    docs = {r.filename: r for r in files.documents(table).collect()}
    assert docs["good.txt"].parse_status == "ok" and docs["good.txt"].content_hash and "Python" in docs["good.txt"].text
    for name in ("ghost.pdf", "mem.txt", "large.txt"):
        assert docs[name].parse_status == "failed" and docs[name].error and docs[name].content_hash == "" and docs[name].text == ""
    # two files that can't be read are no copies of each other
    assert {r.filename: r.parse_status for r in mark_duplicates(files.documents(table)).collect()}["mem.txt"] == "failed"


def test_a_folder_that_may_not_be_entered_is_a_row(inbox):
    reader = folder.FolderReader(inbox, True)
    rows = list(reader.read(folder.Folder(inbox + "/gone", True)))
    assert [r[1:3] for r in rows] == [("gone", None)] and rows[0][3].startswith("unreadable folder:")


def test_folder_counts_copies_failures_and_skipped(spark, inbox):
    scanned = files.scan_folder(spark, inbox)
    assert {r.filename for r in files.skipped(scanned).collect()} == {"skip.png"}
    kept = files.kept(scanned)
    assert {r.filename for r in kept.collect()} == {
        "good.txt", "_draft.txt", "copy.txt", "blank.md", "large.txt", "bad.pdf", "_SUCCESS.txt", "far.TXT"}
    rows = {r.filename: r for r in mark_duplicates(files.documents(kept)).collect()}
    assert rows["blank.md"].parse_status == "empty" and rows["bad.pdf"].parse_status == "failed"
    assert rows["_draft.txt"].parse_status == rows["_SUCCESS.txt"].parse_status == rows["far.TXT"].parse_status == "ok"
    assert [rows[n].parse_status for n in ("copy.txt", "good.txt")] == ["ok", "duplicate"]
    counts = screen(files.documents(kept)).summary.collect()[0]
    assert (counts.total_resumes, counts.parsed_ok, counts.duplicates_skipped, counts.parse_failed) == (8, 5, 1, 2)


def test_missing_folder_and_file_raise(spark, inbox):
    with pytest.raises(FileNotFoundError):
        files.scan_folder(spark, "/no/such/folder/xyz")
    with pytest.raises(NotADirectoryError):
        files.scan_folder(spark, inbox + "/good.txt")
    os.makedirs(inbox + "/empty/of/files")
    assert files.scan_folder(spark, inbox + "/empty").collect() == []


def test_only_contents_of_wanted_kinds_are_opened(spark, inbox):
    rows = {r.filename: r for r in files.scan_folder(spark, inbox).collect()}
    assert rows["skip.png"].content is None and rows["skip.png"].error is None
    assert bytes(rows["bad.pdf"].content).startswith(b"%PDF")


# --- best of several extractions ---

ROWS = [
    ("a", "one", 1, "the data and the model", None, 3), ("a", "two", 2, "thedataandthemodelglued", None, 4),
    ("b", "one", 1, " ", None, 1), ("b", "two", 2, None, "ValueError: bad", None),
    ("c", "one", 1, "glued" * 30, None, 7), ("c", "two", 2, "the data and the model with the team", None, 8),
    ("d", "one", 1, "same text", None, 1), ("d", "one", 1, "same text", None, 1), (None, "one", 1, "no key", None, 1),
]
EXTRACTIONS = "source_file string, extractor string, pri int, text string, error string, page_count int"


def test_best_text_with_its_pages_and_repeated_rows(spark):
    best = {r.source_file: r for r in files.best_extractions(spark.createDataFrame(ROWS, EXTRACTIONS), "source_file").collect()}
    assert set(best) == {"a", "b", "c", "d"}
    assert (best["a"].extractor, best["a"].page_count, best["a"].text) == ("one", 3, "the data and the model")
    assert (best["b"].text, best["b"].error, best["b"].page_count) == (None, "one: no text; two: ValueError: bad", None)
    assert (best["c"].extractor, best["c"].page_count) == ("two", 8)
    assert best["d"].text == "same text"


def test_choice_crosses_no_text_and_the_text_crosses_once(spark, tmp_path):
    spark.createDataFrame(ROWS, EXTRACTIONS).write.parquet(str(tmp_path / "x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = files.best_extractions(spark.read.parquet(str(tmp_path / "x")), "source_file")
        crossed = [columns for _, columns in exchanges(best)]
        texts = [n for n in nodes(best) if n.nodeName() == "ObjectHashAggregate" and "collect_list" in n.toString() and " text#" in n.toString()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(crossed) == 2 and sum("text" in columns for columns in crossed) == 1
    assert ["source_file", "buf"] in crossed and not texts


def test_page_count_reaches_the_documents_table(spark, inbox):
    kept = files.kept(files.scan_folder(spark, inbox))
    given = spark.createDataFrame([(inbox + "/bad.pdf", "one", 1, "the text and the data", None, 2)], EXTRACTIONS)
    rows = {r.filename: r for r in files.documents(kept, given).collect()}
    assert (rows["bad.pdf"].page_count, rows["bad.pdf"].parse_status) == (2, "ok") and rows["good.txt"].page_count is None
