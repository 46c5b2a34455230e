"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark passages.

Each item's windows of consecutive words become patterns of an automaton. A document is
normalised (ASCII lower case, words joined by one space) and scanned once; the words inside
any occurrence are *hit*, and their places are mapped back to code points of the original.

The automaton's size is bounded: a block of items has at most about ``BLOCK_NODES`` characters in its
windows, which are the most nodes there can be, and about 200 MB in a worker. Items are dealt into blocks by hash, long ones in
overlapping pieces. A benchmark of one block is sent with the scan; of several, one is brought to the driver at a time, scans
the documents, and its hits, which are few, are written; then all hits of a row are put together. The result is the same, row by row, for any
number of blocks. A worker builds the automaton of a block once.

Defined results: null or empty text has no words and no hits. A row is judged by its own text: repeated rows get the same result each, rows
that share an id or have none keep their own. An item without words has no window; items with equal text all count; rows of one item_id are one
item. Items without an id are one item more, which has no part in the digest of ids. Other columns of the inputs
are ignored, whatever their names. Texts of any length are scanned in one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import PLAIN_WORD, free_name, small_batches
from evisift.session import written

WINDOW_WORDS = 10
#: Characters in the windows of one automaton, and so the most nodes it has (about 55 bytes each).
BLOCK_NODES = 3_500_000
#: Words of an item in one piece.
PIECE_WORDS = 5_000

#: ASCII letters and digits stay (lower-cased), other ASCII becomes a space, the rest stays.
NORMAL = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)
) + bytes(range(128, 256))
WORD = re.compile(PLAIN_WORD)

HITS = (
    "row long, doc_id long, n_words long, n_hit long, hit_words array<struct<first: long, last: long>>, "
    "spans array<struct<start: long, end: long>>, item_ids array<string>"
)
HITS_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("hit_words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("item_ids", pa.list_(pa.string())),
])


def words_of(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).decode("utf-8", "surrogatepass").split(" ")


def normalised(text: str | None) -> str:
    """The words of a text, each between single spaces."""
    return " " + " ".join(w for w in words_of(text) if w) + " "


Items = tuple[tuple[str | None, str], ...]


def in_order(ids) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


@lru_cache(1)
def automaton(items: Items, window: int = WINDOW_WORDS) -> ahocorasick.Automaton:
    """Pattern: a window with its bounding spaces; value: its number of words and the items that have it.

    The one used last stays with the worker.
    """
    owners: dict[str, tuple[int, set[str | None]]] = {}
    for item, text in items:
        words = [w for w in words_of(text) if w]
        width = min(window, len(words))
        for start in range(len(words) - width + 1 if words else 0):
            owners.setdefault(" " + " ".join(words[start : start + width]) + " ", (width, set()))[1].add(item)
    found = ahocorasick.Automaton()
    for pattern, (width, ids) in owners.items():
        found.add_word(pattern, (width, tuple(in_order(ids))))
    if owners:
        found.make_automaton()
    return found


def occurrences(machine: ahocorasick.Automaton, text: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of words (first, last) inside occurrences, joined where they touch, and the items met."""
    met, items, at, word = [], set(), 0, 0
    for end, (width, ids) in machine.iter(text):
        word += text.count(" ", at, end)  # spaces before the last character: words up to here
        at = end
        met.append((word - width, word - 1))
        items.update(ids)
    met.sort()
    joined: list[list[int]] = []
    for first, last in met:
        if joined and first <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], last)
        else:
            joined.append([first, last])
    return [tuple(x) for x in joined], items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in the original text of ranges of words."""
    places = [m.span() for m in WORD.finditer("".join(c.lower() if c.isascii() else c for c in text))]
    return [(places[first][0], places[last][1]) for first, last in ranges]


def scan(docs: DataFrame, items: Items, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per row: its key, its words, its hit words, spans in the original, items met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, window)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in HITS_ARROW}
            for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                plain = normalised(text)
                ranges, met = occurrences(machine, plain) if len(machine) and len(plain) > 2 else ([], set())
                out["row"].append(row)
                out["doc_id"].append(doc_id)
                out["n_words"].append(plain.count(" ") - 1 if len(plain) > 2 else 0)
                out["n_hit"].append(sum(last - first + 1 for first, last in ranges))
                out["hit_words"].append([{"first": a, "last": b} for a, b in ranges])
                out["spans"].append([{"start": a, "end": b} for a, b in original_spans(text, ranges)] if ranges else [])
                out["item_ids"].append(in_order(met))
            yield pa.RecordBatch.from_pydict(out, schema=HITS_ARROW)

    return identified(docs).mapInArrow(run, HITS)


def identified(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: ``row`` stands for the pair of the other two."""
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc, F.coalesce("text", F.lit(""))).alias("row"), doc.alias("doc_id"), "text")


def pieces_of(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item, text)``: the items with words, long ones in pieces that share all but one word of a window."""
    step = max(1, PIECE_WORDS - window + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in words_of(text) if w]
                for start in range(0, max(1, len(words) - window + 1), step):
                    items.append(item)
                    texts.append(" ".join(words[start : start + step + window - 1]))
            yield pa.RecordBatch.from_pydict({"item": items, "text": texts}, schema=pa.schema([("item", pa.string()), ("text", pa.string())]))

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return given.mapInArrow(cut, "item string, text string").filter("text <> ''")


def item_blocks(benchmark: DataFrame, window: int, block_chars: int | None) -> Iterator[tuple[int, Items]]:
    """The number of blocks, with the items of one after the other; one empty block if there are none.

    ``block_chars`` is how much text a block may have; every character stands in at most ``window`` windows.
    """
    small_batches(benchmark.sparkSession)
    most = BLOCK_NODES // window if block_chars is None else block_chars
    pieces = pieces_of(benchmark, window)
    chars = pieces.agg(F.coalesce(F.sum(F.length("text") + 2), F.lit(0))).first()[0]
    blocks = 1 if chars <= most else 1 + 2 * chars // most
    if blocks > 1:
        pieces = written(pieces, "items")
    for b in range(blocks):
        yield blocks, tuple(sorted(
            ((r[0], r[1]) for r in pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()),
            key=lambda x: (x[0] is None, x),
        ))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_chars: int | None = None) -> DataFrame:
    """Every row with its hits: ``doc_id, n_words, n_hit, hit_words, spans, item_ids``."""
    each = []
    for blocks, items in item_blocks(benchmark, window, block_chars):
        scanned = scan(docs, items, window)
        if blocks == 1:
            return scanned.drop("row")
        each.append(written(scanned.filter("n_hit > 0").dropDuplicates(["row"]), "hits"))
    counted = scan(docs, (), window).select("row", "doc_id", "n_words")
    hits = merged_blocks(reduce(DataFrame.unionByName, each))
    joined = counted.join(hits, "row", "left")
    none = {"hit_words": "array<struct<first: bigint, last: bigint>>", "spans": "array<struct<start: bigint, end: bigint>>", "item_ids": "array<string>"}
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        *[F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in none.items()],
    )


def merged_blocks(found: DataFrame) -> DataFrame:
    """Hits of the same row in several blocks, as one row: unions of places and items."""
    pieces = found.groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("hit_words"))).alias("w"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    joined = """aggregate({c}, cast(array() as array<struct<{a}: bigint, {b}: bigint>>), (done, x) ->
        if(size(done) > 0 and x.{a} <= element_at(done, -1).{b} + {gap},
           concat(slice(done, 1, size(done) - 1), array(named_struct('{a}', element_at(done, -1).{a}, '{b}', greatest(element_at(done, -1).{b}, x.{b})))),
           concat(done, array(x))))"""
    whole = pieces.withColumn("hit_words", F.expr(joined.format(c="w", a="first", b="last", gap=1)))
    # spans follow the ranges of words: those whose words touch are one
    places = """transform(hit_words, h -> named_struct(
        'start', array_min(transform(filter(arrays_zip(w, s), z -> z.w.first >= h.first and z.w.last <= h.last), z -> z.s.start)),
        'end', array_max(transform(filter(arrays_zip(w, s), z -> z.w.first >= h.first and z.w.last <= h.last), z -> z.s.end))))"""
    return whole.select(
        "row", F.expr("aggregate(hit_words, 0L, (n, x) -> n + x.last - x.first + 1)").alias("n_hit"), "hit_words",
        F.expr(places).alias("spans"), "item_ids",
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_chars: int | None = None) -> DataFrame:
    """The documents without a hit word, with all their columns unchanged. A hit document goes as a whole."""
    each = []
    for blocks, items in item_blocks(benchmark, window, block_chars):
        if blocks == 1:
            return without_hits(docs, items, window)
        each.append(written(scan(docs, items, window).filter("n_hit > 0").select("row").distinct(), "hits"))
    row = free_name(docs, "_hit_row")
    hit = reduce(DataFrame.unionByName, each).distinct().withColumnRenamed("row", row)
    own = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, own == hit[row], "left_anti")


def without_hits(docs: DataFrame, items: Items, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, window)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = [not len(machine) or next(machine.iter(normalised(t)), None) is None for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The same in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
met AS (SELECT p.doc_id, p.i, p.width, v.item_id FROM places p JOIN windows v ON p.gram = v.gram AND p.width = v.width),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS k FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
