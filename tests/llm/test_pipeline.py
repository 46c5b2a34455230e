"""The pipeline, and that its parts stand where they should."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from evisift.llm import bpe, decontamination, queries
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_substring_dedup import brute as brute_passages

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SMALL).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        old, new = ({r["doc_id"]: r for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old), name
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "n-gram Jaccard join":
            sets = [(i, shingles(r["text"])) for i, r in sorted(new.items())]
            linked = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and 100 * len(a & b) >= 75 * len(a | b)]
            assert not linked
        elif name == "substring dedup":
            # what is left is each passage once; every text that lost something is shorter
            assert all(r["n_chars"] == len(r["text"]) for r in new.values())
            hit = brute_passages([(i, r["text"]) for i, r in old.items()])
            untouched = {i for i, words in hit.items() if not words}
            assert all(new[i]["text"] == old[i]["text"] for i in untouched)
        elif name == "benchmark decontamination":
            found = {r["doc_id"]: r["n_hit"] for r in decontamination.find(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(new) == {i for i, n in found.items() if not n}
        elif name == "BPE encoding and decoding":
            tokenizer = bpe.tokenizer(queries.TOKENIZER)
            assert all(r["ids"] == tokenizer.encode(old[i]["text"], add_special_tokens=False).ids for i, r in new.items())
        else:
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            wrong = [i for i, r in labels.items() if (i in new) != (r["quality"] == 1 and r["toxic"] == 0)]
            assert len(wrong) <= 0.1 * len(labels)
        before = after
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r["doc_id"] for r in before.collect())


def landed(spark, folder, rows, schema, labels, benchmark):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    prose = lambda k: " ".join(f"{w}{k}" for w in "the house stands near an old river where children play and birds sing every morning of spring".split())
    item = " ".join(f"question{k}" for k in range(12))
    rows = [(k, prose(k) + ". " + prose(k + 1000)) for k in range(30)]
    rows += [(40, rows[3][1]), (3, rows[3][1]), (None, prose(500) + " " + prose(501)), (None, rows[4][1]), (41, None), (42, ""), (43, f"{prose(600)} {item} {prose(601)}")]
    wide = [(i, t, len(t or ""), "x", "s", 1, 2, "d") for i, t in rows]
    schema = "doc_id long, text string, n_chars long, _gone_doc string, _spans string, _doc int, row int, kept string"
    folder = landed(spark, str(tmp_path / "in"), wide, schema, [(k, 1, 0) for k in range(30)] + [(5, None, None), (None, 0, 1)], [("q", item), (None, "no such words here"), ("z", None)])
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in got]
    assert set(range(30)) <= set(ids) and not {40, 41, 42, 43} & set(ids)
    assert ids.count(3) == 2  # a repeated row meets the same decision
    assert ids.count(None) == 1  # the other is a copy of document 4
    stages = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, folder)
        assert stages.columns == [c.split(" ")[0] for c in schema.split(", ")]


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    folder = landed(spark, str(tmp_path / "in"), [], "doc_id long, text string, lang string", [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_the_rest_does_not_need_this_subpackage():
    code = (
        "import sys; sys.modules['evisift.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    for file in [*(REPO / "evisift").rglob("*.py"), *(REPO / "evisift_checks").rglob("*.py"), *(REPO / "tests").glob("*.py")]:
        if "llm" not in file.parts:
            assert not re.search(r"evisift\.llm|corpus_pipeline", file.read_text()), file
