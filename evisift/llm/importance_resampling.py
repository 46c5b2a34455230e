"""Target-distribution importance resampling over hashed n-gram features.

Every run of consecutive words is a feature; its bucket is the CRC-32 of its bytes modulo the
number of buckets. A bucket's gain is the log ratio of its smoothed share in the target and in the
raw documents; a document's weight is the mean gain of its features; the documents with the
highest weight plus Gumbel noise are drawn, which samples without replacement in proportion
to the weights.

A chunk of documents is brought to lower-case words with one separator between them, and
scanned once, storing the running CRC after every byte. CRCs are linear over GF(2): if ``R`` is
the register after each prefix, the register of bytes ``a..b`` alone is ``R[b]`` plus ``R[a]`` shifted
over ``b - a`` bytes, which cancels everything before ``a``. So the CRC of any n-gram comes from two prefixes,
whatever its length, without another look at its bytes.

The scan is vectorised: the bytes are cut into lanes that advance in step. The first pass starts
all lanes at zero; the register each lane really starts with follows from the one before
by a shift over the lane's length, and the second pass stores the running CRCs.

Documents are read once: the buckets of their features are written, two bytes each, and both counting and weighing read that
table. Only one count for each bucket leaves a task and reaches the driver; ranks come from a range sort of narrow rows.

Defined results: null or empty text has no words: no features, weight 0, never drawn. A null
``doc_id`` hashes as the empty text and ranks behind others of its score; among repeated rows each is a document of its
own, with neighbouring ranks in any order. Without target texts, or without documents, the shares are those of the smoothing. Columns other than
those read are ignored. A very long text is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import chunked, one_array
from evisift.operators.ranking import numbered
from evisift.session import written

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)

#: Words are ASCII letters and digits (lower-cased) and everything beyond ASCII; the rest separates.
NORMAL = np.array([ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)] + [*range(128, 256)], np.uint8)

WEIGHED = "doc_id long, n_words long, n_features long, weight long, score long"
WEIGHED_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_words", "n_features", "weight", "score")])


@dataclass(frozen=True)
class Resampling:
    """Shortest and longest run of words, buckets, fewest words of a drawn document, percent drawn, seed of the noise."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


def byte_table() -> np.ndarray:
    """What one byte does to the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTE = byte_table()


def shift_tables(bits: int = 32) -> list[np.ndarray]:
    """For each power of two, how that many zero bytes move a register: one table for each of its four bytes."""
    def of(step) -> np.ndarray:
        return np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])

    tables = [of(lambda x: BYTE[x & 0xFF] ^ (x >> np.uint32(8)))]
    for _ in range(bits - 1):
        last = tables[-1]
        tables.append(of(lambda x: moved(moved(x, last), last)))
    return tables


def moved(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    x = register
    return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]


SHIFTS = shift_tables()


def shifted(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each register after its own number of zero bytes."""
    out = register.copy()
    for bit in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        some = np.flatnonzero((zeros >> bit) & 1)
        out[some] = moved(out[some], SHIFTS[bit])
    return out


def running_crc(data: np.ndarray) -> np.ndarray:
    """The register, begun at zero, before each byte and after the last."""
    size = len(data)
    width = math.isqrt(size) + 1
    lanes = -(-size // width)
    steps = np.zeros(lanes * width, np.uint8)
    steps[:size] = data
    steps = np.ascontiguousarray(steps.reshape(lanes, width).T)

    def scan(register: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        for t in range(width):
            register = BYTE[(register ^ steps[t]) & 0xFF] ^ (register >> np.uint32(8))
            if keep is not None:
                keep[t] = register
        return register

    ends = scan(np.zeros(lanes, np.uint32), None)
    begins = np.zeros(lanes, np.uint32)
    for lane in range(1, lanes):
        before = begins[lane - 1 : lane]
        begins[lane] = shifted(before, np.array([width]))[0] ^ ends[lane - 1]
    kept = np.empty((width, lanes), np.uint32)
    scan(begins, kept)
    return np.concatenate([np.zeros(1, np.uint32), kept.T.reshape(-1)[:size]])


def crc_between(running: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes ``first..end`` of each pair, from the two prefixes alone."""
    return shifted(running[first] ^ ONES, end - first) ^ running[end] ^ ONES


def word_bounds(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The separator-normalised bytes of all texts, where each word begins and ends, and words per text."""
    texts = one_array(texts).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    # one separator after each text
    spaced = np.insert(NORMAL[data], ends, 32)
    inside = spaced != 32
    after = np.concatenate([[False], inside[:-1]])  # the byte before is part of a word
    keep = inside | after
    place = np.cumsum(keep) - 1
    begins = np.flatnonzero(inside & ~after)
    counts = np.diff(np.searchsorted(begins, np.concatenate([[0], ends + 1 + np.arange(len(texts))])))
    return spaced[keep], place[begins], place[np.flatnonzero(~inside & after)], counts


def features(texts: pa.ChunkedArray | pa.Array, how: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the bucket of every feature, and the text each belongs to."""
    data, begins, ends, counts = word_bounds(texts)
    running = running_crc(data)
    last = np.repeat(np.cumsum(counts), counts)  # of each word: where its text's words end
    owner = np.repeat(np.arange(len(counts)), counts)
    buckets, owners = [], []
    for n in range(how.shortest, how.longest + 1):
        fits = np.flatnonzero(np.arange(len(begins)) + n <= last)
        buckets.append(crc_between(running, begins[fits], ends[fits + n - 1]) % np.uint32(how.buckets))
        owners.append(owner[fits])
    return counts, np.concatenate(buckets), np.concatenate(owners)


def featured(texts: DataFrame, how: Resampling, *keep: str) -> DataFrame:
    """The columns to ``keep``, ``n_words``, and ``buckets``: the bucket of every feature of a text, one after the other."""
    kind = np.dtype(np.uint16 if how.buckets <= 2**16 else np.uint32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            counts, buckets, owner = features(part.column("text"), how)
            if how.longest > how.shortest:
                buckets = buckets[np.argsort(owner, kind="stable")]
            ends = np.cumsum(np.bincount(owner, minlength=len(counts))) * kind.itemsize
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            data = pa.py_buffer(np.ascontiguousarray(buckets.astype(kind)))
            listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), data])
            arrays = [*(one_array(part.column(n)) for n in keep), pa.array(counts.astype(np.int64)), listed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_words", "buckets"])

    schema = "".join(f"{n} long, " for n in keep) + "n_words long, buckets binary"
    return texts.select(*keep, "text").mapInArrow(task, schema)


def numbers_of(column: pa.ChunkedArray | pa.Array, how: Resampling) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of texts, and how many each text has."""
    kind = np.dtype(np.uint16 if how.buckets <= 2**16 else np.uint32)
    listed = one_array(column).cast(pa.large_binary())
    offsets = np.frombuffer(listed.buffers()[1], np.int64)[listed.offset : listed.offset + len(listed) + 1]
    data = np.frombuffer(listed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(listed) else np.empty(0, np.uint8)
    return data.view(kind), np.diff(offsets) // kind.itemsize


def bucket_counts(rows: DataFrame, how: Resampling) -> np.ndarray:
    """How many features of all texts fall into each bucket: one number for each leaves a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            total += np.bincount(numbers_of(batch.column(0), how)[0], minlength=how.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": found, "n": total[found]})

    counted = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, np.int64)
    for bucket, n in counted.collect():  # at most one row for each bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares."""
    size, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_raw + size) / ((s + 1.0) * (all_target + size))))
        for s, t in zip(raw.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandths of a standard Gumbel draw that depends on seed and id alone."""
    named = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(found: DataFrame, gain: np.ndarray, how: Resampling) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row of ``found(doc_id, n_words, buckets)``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            buckets, n = numbers_of(part.column("buckets"), how)
            sums = np.concatenate([[0], np.cumsum(gain[buckets])])
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            ids = part.column("doc_id")
            score = weight + np.array([noise(i, how.seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, part.column("n_words"), pa.array(n), pa.array(weight), pa.array(score)], schema=WEIGHED_ARROW
            )

    return found.select("doc_id", "n_words", "buckets").mapInArrow(task, WEIGHED)


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``rank`` is null for those not drawn."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(featured(given, how, "doc_id"), "features")
    gain = gains(bucket_counts(found, how), bucket_counts(featured(target, how), how))
    weighed = written(weigh(found, gain, how), "weighed")
    long_enough = F.col("n_words") >= how.min_words
    drawn = how.percent * weighed.filter(long_enough).count() // 100
    order = [
        long_enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(),
        F.col("spread").asc(),  # repeated ids don't pile up in one range
    ]
    placed = numbered(weighed.withColumn("spread", F.monotonically_increasing_id()), order)
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(long_enough & (F.col("position") <= drawn), F.col("position")).cast("long").alias("rank"),
    )
