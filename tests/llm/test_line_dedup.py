"""Line dedup against a plain loop and its SQL twin."""

import collections
import hashlib
import re

import duckdb

from evisift.llm import line_dedup, queries


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), bare)


def plain(rows, least=10):
    lines = {(i, t or ""): (t or "").split("\n") for i, t in rows}
    seen = collections.Counter(k for doc in lines.values() for k in {key(x) for x in doc} if k)
    out = []
    for i, t in rows:
        every = lines[(i, t or "")]
        kept = [x for x in every if seen[key(x)] < least]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def got(docs, least=10):
    rows = line_dedup.digest(line_dedup.dedup(docs, least)).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_given_documents_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_line_dedup(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(plain([tuple(r) for r in docs]))
    assert found.agg({"n_dropped": "sum"}).first()[0] > 0


ROWS = [
    (0, "Footer\nown 0\n  FOOTER \t\n\nend"), (1, "a\r\nfooter\r\nb"), (2, "footer"), (3, "footer\nfooter"), (4, None), (5, ""),
    (6, "\n\n"), (7, "É\nfooter"), (8, "É\né"), (9, "\xa0footer\n\x0bfooter\x0c"), (10, "x" * 200_000 + "\nfooter"),
    (11, "\n".join(f"line {k}" for k in range(20_000)) + "\nfooter"), (12, "footer "), (12, "footer "), (12, "other\nfooter"),
    (None, "footer\nnull"), (None, "footer\nnull"), (None, None), (None, "null again\nfooter"),
]


def test_odd_rows_and_clashing_columns(spark):
    wide = [(i, t, "n", 1, "g") for i, t in ROWS]
    docs = spark.createDataFrame(wide, "doc_id long, text string, key string, at int, gone string")
    for least in (1, 2, 4, 9, 10, 13, 14):
        assert got(docs.repartition(3), least) == plain(ROWS, least), least
    assert got(docs.union(docs), 13) == sorted(2 * plain(ROWS, 13), key=lambda r: tuple(map(str, r)))
    assert line_dedup.dedup(docs.limit(0)).collect() == []


def test_sql_twin_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    # DuckDB keeps repeated rows apart too
    rows = db.execute(line_dedup.ORACLE).fetchall()
    assert sorted(rows, key=lambda r: tuple(map(str, r))) == got(docs)


def test_a_line_of_every_document_and_lines_of_few(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 5)
    rows = [(i, f"everywhere\nof ten {i // 10}\nof nine {i // 9}\nown {i}") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == plain(rows)
    assert sum(r[2] for r in got(docs)) == 360


def test_pieces_between(spark):
    table = spark.createDataFrame([(list("abcde"), g) for g in ([], [0], [4], [1, 2], [0, 4], [0, 1, 2, 3, 4])], "lines array<string>, gone array<int>")
    pieces = [r[0] for r in table.select(line_dedup.between(table["lines"], table["gone"])).collect()]
    assert ["".join(p) for p in pieces] == ["abcde", "bcde", "abcd", "ade", "bcd", ""]


def test_text_crosses_one_exchange(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    lines = line_dedup.keyed_lines(docs)
    assert lines.columns == ["doc", "at", "key"] and dict(lines.dtypes)["key"] == "bigint"
    plan = line_dedup.common_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "hashpartitioning(key#" in plan.split("Exchange", 2)[-1]
