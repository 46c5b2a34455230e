"""Line dedup: lines that stand in many documents go from all of them.

Lines are exploded and their normalised keys hashed; distinct documents are counted per
hash; documents get the positions of their lines over the threshold and are put together
again from what lies between.

Only narrow rows (document, hash, position) meet by hash; the text itself crosses one
exchange, to meet the positions of its document. Counting distinct documents goes through
(hash, document) first, so a line that every document has costs no task more than its
share. For the way back, lines held by more than 1 / HOT_SHARE of all rows are at most
HOT_SHARE in number and are broadcast; all others meet in a shuffled join, where none of
them is larger than that share.

Defined results: a document is a distinct pair of ``doc_id`` and text, so repeated rows count
once, rows with one id and different texts (also null ids) count each, and all rows
are returned. Null text is empty: one empty line, which is never dropped, as its key has no
code point. An empty table gives an empty result. Columns other than ``doc_id`` and ``text``
are ignored, whatever their names. Texts and lines may have any length; the memory of a step is
that of one document. Documents and lines are told apart by 64-bit hashes (see ``common``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import UPPER
from evisift.session import written

MIN_DOCS = 10
MIN_CHARS = 1
#: A line in more than this part of all rows is broadcast on its own: there can be no more such lines.
HOT_SHARE = 10_000
#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.char_length(bare)
    # all ASCII: lower() changes A-Z alone and is much faster than a translation
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def identified(docs: DataFrame) -> DataFrame:
    """``(doc, doc_id, text)``, where ``doc`` stands for the pair of the other two."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc, at, key)``: the hash of every line with a key of at least ``min_chars`` code points."""
    lines = identified(docs).select("doc", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    keys = lines.select("doc", "at", line_key(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= min_chars).select("doc", "at", F.xxhash64("key").alias("key"))


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(key, n_docs)`` of the lines of at least ``min_docs`` documents."""
    return lines.groupBy("key").agg(F.count_distinct("doc").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dropped_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """``(doc, at)`` of every line whose key is common; both inputs are written tables."""
    share = max(1, lines.count() // HOT_SHARE)
    hot = common.filter(F.col("n_docs") > share).select("key", F.lit(True).alias("hot"))
    cold = common.filter(F.col("n_docs") <= share).select("key")
    marked = lines.join(F.broadcast(hot), "key", "left")
    rare = marked.filter("hot IS NULL").join(cold, "key", "left_semi")
    return marked.filter("hot").select("doc", "at").union(rare.select("doc", "at"))


def between(lines: Column, gone: Column) -> Column:
    """The lines between the sorted positions ``gone``, in one pass over both."""
    def piece(i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, first + 1, end - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), piece))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)``: every text without the lines that ``min_docs`` documents have."""
    lines = written(keyed_lines(docs, min_chars), "lines")
    common = written(common_lines(lines, min_docs), "common-lines")
    gone = (
        dropped_lines(lines, common).groupBy("doc")
        .agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )
    joined = identified(docs).join(gone, "doc", "left").select(
        "doc_id", "text", "gone", split_lines(F.col("text")).alias("lines")
    )
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(between(F.col("lines"), F.col("gone")), "\n")).alias("kept"),
    )


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
), lines AS (
    SELECT row_no, doc_id, body, unnest(split(body, chr(10))) AS line,
           generate_subscripts(split(body, chr(10)), 1) AS line_no
    FROM docs
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key FROM keyed WHERE length(key) >= 1
    GROUP BY key HAVING count(DISTINCT row(doc_id, sha256(body))) >= 10
), marked AS (
    SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.key = common.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no
"""
