"""Pieces that several operators of this subpackage share.

Text work that needs Python runs on Arrow batches inside Spark tasks; Spark partitions and
shuffles it. Two helpers keep it cheap. ``chunked`` regroups the documents of a task into
chunks of a bounded number of characters, so that memory does not depend on the size of a
partition. ``packed`` and ``unpacked`` carry numpy arrays through a shuffle as one
compressed value, so that millions of small numbers are not millions of rows.

Word and shingle identities are 64-bit hashes; two different ones are taken for the same
with a chance of about n * n / 2**65 over n distinct ones.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text in one chunk: the unit of Python memory.
CHUNK_CHARS = 4_000_000
SHINGLE_WORDS = 5
#: Similarity from which texts and passages are near duplicates, as percent.
SIMILAR_PERCENT = 75

#: Rows of one batch between Spark and Python.
BATCH_ROWS = 1_000
#: The C library's call that returns free memory, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words as runs between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Words as runs of ASCII letters, digits and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column has it already, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_partners(
    rows: DataFrame, partners: DataFrame, keys: list[str], copies: str, share: int = 10_000, total: int | None = None
) -> DataFrame:
    """``rows`` LEFT JOIN ``partners``, which have each combination of ``keys`` once, with its number of rows in ``copies``.

    Both are written tables, and partners are narrow. Combinations of more than 1 / ``share`` of all rows are at most ``share`` and
    are broadcast; the others meet in a shuffled join, in which none of them is larger than that.
    """
    most = max(1, (rows.count() if total is None else total) // share)
    others = [c for c in partners.columns if c not in keys and c != copies]
    hot = partners.filter(F.col(copies) > most).select(*keys, F.struct(*others).alias("_hot"))
    cold = partners.filter(F.col(copies) <= most).select(*keys, *others)
    marked = rows.join(F.broadcast(hot), keys, "left")
    met = marked.filter("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    return met.unionByName(marked.filter("_hot IS NULL").select(*rows.columns).join(cold, keys, "left"))


def salted_join(rows: DataFrame, partners: DataFrame, key: str, spread: str, share: int = 200) -> DataFrame:
    """``rows`` JOIN ``partners``, which have each ``key`` once and may be wide; both are written tables.

    A key of more than 1 / ``share`` of all rows is dealt over as many parts as it has such shares, by a hash of ``spread``, and its
    partner is copied to each: at most ``share`` copies more in all.
    """
    most = max(1, rows.count() // share)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    # fewer keys than shares
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copied = partners.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def chunked(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """The rows of a task in order, as tables of at least ``chars`` bytes of text (the last one: fewer)."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, length in enumerate(lengths.tolist()):
            size += length + 16
            if size >= chars:
                held.append(batch.slice(start, row + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, row + 1
                give_back()
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        give_back()


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of no more than ``BATCH_ROWS``, which both sides hold whole, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return free memory to the machine: a Python worker lives on after its task, with other workers beside it."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def spaced_words(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, the words' codes in one row, and the distinct words the codes stand for.

    ASCII letters are lower-cased; words are runs between ASCII white space; null is empty.
    """
    texts = pc.fill_null(one_array(texts), "")
    lists = one_array(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    coded = flat.filter(full).dictionary_encode()
    return counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint64)
    return mixed(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit numbers; each seed gives another one."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive entries."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    end = len(hashes) - width + 1
    total = hashes[:end].copy()
    for k in range(1, width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + end]
    return mixed(total, width)


def text_shingles(hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingle at every place where one fits inside its text, and the text each belongs to.

    A text with fewer words than ``width`` (but not none) has its whole word sequence as its one shingle.
    """
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = run_hashes(hashes, width)
    place = np.arange(len(runs))
    fits = place + width <= ends[owner[: len(runs)]]
    shingles, owners = runs[fits], owner[: len(runs)][fits]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [run_hashes(hashes[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
        shingles = np.concatenate([shingles, np.array(whole, np.uint64)])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        shingles, owners = shingles[order], owners[order]
    return shingles, owners


def packed(**arrays: np.ndarray) -> bytes:
    """Flat arrays (numbers, or objects that are all strings) as one compressed value.

    Numbers are stored byte by byte of their width, strings as one text and their lengths:
    both compress far better than the plain arrays.
    """
    flat = {}
    for name, array in arrays.items():
        if array.dtype == object:
            strings = array.tolist()
            array = np.fromiter(map(len, strings), np.int32, len(strings))
            flat[f"{name}/text"] = "".join(strings)
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
        flat[name] = (array.dtype.str, planes.tobytes())
    return zstandard.compress(pickle.dumps(flat, protocol=5), 3)


def unpacked(value: bytes) -> dict[str, np.ndarray]:
    flat, arrays = pickle.loads(zstandard.decompress(value)), {}
    for name, stored in flat.items():
        if name.endswith("/text"):
            continue
        kind, planes = np.dtype(stored[0]), np.frombuffer(stored[1], np.uint8)
        array = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
        if f"{name}/text" in flat:
            text, ends = flat[f"{name}/text"], np.cumsum(array).tolist()
            strings = np.empty(len(array), object)
            strings[:] = [text[b - n : b] for b, n in zip(ends, array.tolist())]
            array = strings
        arrays[name] = array
    return arrays


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
