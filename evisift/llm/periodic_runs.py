r"""Periodic runs: stretches of words that repeat with a period, found by internal pattern matching.

A run is a stretch whose smallest period is ``q`` words, at least ``max(min_words, 2 * q)`` long, which no
neighbouring word extends. For every power of two ``b`` the text is cut into blocks of ``b`` words that start at multiples of
``b``. A run of period ``p`` with ``2 * b - 1 <= p <= 4 * b - 2`` holds such a block in its first ``p`` words, and holds the
block again ``p`` words later. So each block asks for its own occurrences in the window of starts that many
words ahead (blocks of two also for the shorter periods, as a run has twelve words or more):

1. the suffix array comes from prefix doubling, whose ranks also name every block of ``b`` words: a block's
   occurrences are the interval of the suffix array that starts at its rank;
2. a wavelet tree (in matrix form) over the suffix array counts, for an interval and a window of starts, the occurrences
   and returns any of them in order: range successor in one step for each bit;
3. a window of ``b`` starts holds none, one, two, or an arithmetic progression of occurrences, known from the first, second
   and last. Where block and progression lie in one stretch of the progression's difference, that
   difference divides the distance, which then is no smallest period; otherwise each distance is a candidate period;
4. a candidate is extended to both sides as far as words that far apart agree, by the ranks of the doubling. Stretches of sufficient
   length are runs; of several periods for one stretch the smallest counts.

All steps run on numpy arrays over a chunk of documents at once; words of different documents never compare equal. The work is
O(n log n) in the words of a document, whatever it repeats, and needs no shuffle.

Defined results: null, empty and blank texts have no words and no runs; their collapsed text is empty. Repeated rows are judged
one by one. Columns other than ``doc_id`` and ``text`` are ignored. A very long text is a chunk of its own: a
task's memory is in proportion to its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import chunked, one_array

MIN_WORDS = 12
CHARS = 2_000_000

RUN = "struct<start: long, length: long, period: long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: From (doc_id, number of words) to the word that stands at each place instead.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def block_ranks(codes: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... words that start at each place, and the suffix array.

    ``codes`` tells words apart, by document as well; ``ends`` is where each word's document ends. A rank is the number of
    smaller blocks, so equal blocks share the rank at which their interval of the suffix array starts. The last
    level is the last one with equal blocks.
    """
    size = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(size, np.int32)

    def split(active: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give the slots ``active`` of the order their ranks by sorted keys; return the slots that share theirs."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        rank[order[active]] = active[first][np.cumsum(new) - 1]
        return active[np.repeat(np.diff(np.concatenate([first, [len(active)]])) > 1, np.diff(np.concatenate([first, [len(active)]])))]

    active = split(np.arange(size), codes[order])
    ranks, width = [], 1
    while len(active):
        ranks.append(rank.copy())
        place = order[active]
        after = np.where(place + width < ends[place], rank[np.minimum(place + width, size - 1)], -1)
        keys = rank[place].astype(np.int64) * (size + 1) + after + 1
        by_key = np.argsort(keys, kind="stable")
        order[active] = place[by_key]
        active = split(active, keys[by_key])
        width *= 2
    return ranks, order


class WaveletMatrix:
    """The suffix array, bit by bit from the highest; every level sorts stably by its bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []  # per level: how many zero bits stand before each place
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than its bound."""
        total = np.where(bound >= 1 << self.bits, right - left, 0)
        left, right = left.copy(), right.copy()
        for level, zeros in enumerate(self.zeros):
            one = ((bound >> (self.bits - 1 - level)) & 1).astype(bool)
            l0, r0 = zeros[left], zeros[right]
            total += np.where(one & (bound < 1 << self.bits), r0 - l0, 0)
            left = np.where(one, zeros[-1] + left - l0, l0)
            right = np.where(one, zeros[-1] + right - r0, r0)
        return total

    def smallest(self, left: np.ndarray, right: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The value of each interval that has ``number`` smaller ones in it."""
        value = np.zeros(len(left), np.int64)
        left, right, number = left.copy(), right.copy(), number.copy()
        for level, zeros in enumerate(self.zeros):
            l0, r0 = zeros[left], zeros[right]
            one = number >= r0 - l0
            number = np.where(one, number - (r0 - l0), number)
            left = np.where(one, zeros[-1] + left - l0, l0)
            right = np.where(one, zeros[-1] + right - r0, r0)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
        return value


def agree_after(ranks: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on (``a < b``, one document)."""
    total, limit, last = np.zeros(len(a), np.int64), ends[a], len(ends) - 1
    for level in reversed(range(len(ranks))):
        x, y = a + total, b + total
        same = (y + (1 << level) <= limit) & (ranks[level][np.minimum(x, last)] == ranks[level][np.minimum(y, last)])
        total += same.astype(np.int64) << level
    return total


def agree_before(ranks: list[np.ndarray], begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before ``a`` equal those before ``b`` (``a < b``, one document)."""
    total, limit = np.zeros(len(a), np.int64), begins[a]
    for level in reversed(range(len(ranks))):
        x, y = a - total - (1 << level), b - total - (1 << level)
        same = (x >= limit) & (ranks[level][np.maximum(x, 0)] == ranks[level][np.maximum(y, 0)])
        total += same.astype(np.int64) << level
    return total


def candidates(ranks: list[np.ndarray], tree: WaveletMatrix, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places and distances: a block starts at the place, and again at that distance."""
    size = len(ends)
    for level in range(1, len(ranks)):
        width = 1 << level
        block = np.arange(0, size, width)
        block = block[block + width <= ends[block]]
        left = ranks[level][block].astype(np.int64)
        count = np.bincount(ranks[level], minlength=size)[left]
        some = count > 1
        block, left, right = block[some], left[some], (left + count)[some]
        low, high = 2 * width - 1 if level > 1 else 1, 4 * width - 1
        for begin in range(low, high, width):
            from_, to = block + begin, block + min(begin + width, high)
            before, upto = tree.below(left, right, from_), tree.below(left, right, to)
            hit = np.flatnonzero(upto > before)
            at, lo, hi, k, n = block[hit], left[hit], right[hit], before[hit], (upto - before)[hit]
            first = tree.smallest(lo, hi, k)
            yield at, first - at
            two = n > 1
            at, lo, hi, k, n, first = at[two], lo[two], hi[two], k[two], n[two], first[two]
            second = tree.smallest(lo, hi, k + 1)
            yield at, second - at
            more = n > 2
            at, lo, hi, k, n, first, second = at[more], lo[more], hi[more], k[more], n[more], first[more], second[more]
            step = second - first
            last = tree.smallest(lo, hi, k + n - 1)
            apart = at + step + agree_after(ranks, ends, at, at + step) < first + width
            at, second, step, last = at[apart], second[apart], step[apart], last[apart]
            terms = (last - second) // np.maximum(step, 1)
            owner = np.repeat(np.arange(len(at)), terms)
            term = np.arange(len(owner)) - np.repeat(np.cumsum(terms) - terms, terms) + 1
            yield at[owner], second[owner] + term * step[owner] - at[owner]


def runs_of(words: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs in a row of documents, by start, then period.

    ``words`` tells the words apart, ``counts`` is how many each document has. Starts count over the row.
    ``min_words`` of less than 12 would need shorter blocks.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"runs of less than {MIN_WORDS} words are not searched")
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    stop = np.cumsum(counts)
    ends, begins = np.repeat(stop, counts), np.repeat(stop - counts, counts)
    codes = np.repeat(np.arange(len(counts)), counts) * (int(words.max()) + 1) + words
    ranks, order = block_ranks(codes, ends)
    if len(ranks) < 2:
        return none, none, none
    tree = WaveletMatrix(order)
    found = []
    for at, period in candidates(ranks, tree, ends):
        start = at - agree_before(ranks, begins, at, at + period)
        end = at + period + agree_after(ranks, ends, at, at + period)
        fits = end - start >= np.maximum(min_words, 2 * period)
        found.append(np.stack([start[fits], end[fits], period[fits]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows
    start, length, period = rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]
    by_start = np.lexsort((period, start))
    return start[by_start], length[by_start], period[by_start]


def chunk_runs(part: pa.Table, min_words: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    ids = one_array(part.column("doc_id"))
    lists = one_array(pc.ascii_split_whitespace(pc.fill_null(one_array(part.column("text")), "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(lists))
    words = flat.filter(full)
    begin = np.cumsum(counts) - counts
    if rewrite is not None:
        take = np.arange(len(words))
        for doc, (doc_id, first, n) in enumerate(zip(ids.to_pylist(), begin.tolist(), counts.tolist())):
            new = rewrite(doc_id, n) if n else None
            if new is not None:
                take[first : first + n] = first + new
        words = words.take(pa.array(take))
    start, length, period = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), counts, min_words)

    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), " ")

    doc = np.searchsorted(np.cumsum(counts), start, side="right")
    runs = pa.StructArray.from_arrays([pa.array(start - begin[doc]), pa.array(length), pa.array(period)], fields=list(RUN_ARROW))
    offsets = np.searchsorted(doc, np.arange(len(counts) + 1))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), collapsed],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def find(docs: DataFrame, min_words: int = MIN_WORDS, rewrite: Rewrite | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: all runs of every document by start, then period, and its words without repeats.

    A word is left out of ``collapsed`` where a run holds it after that run's first period. ``rewrite`` may put other
    words of the document in place of each; starts and collapsed text are those of the rewritten document.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, chars=CHARS):
            yield chunk_runs(part, min_words, rewrite)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, FOUND)


def repeating_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rewriting: a tenth of all documents, by the checksum of their id, ends in a repeated stretch."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place >= a, a + (place - a) % p, place)


def digest(found: DataFrame) -> DataFrame:
    """Per document: the number of runs, the longest one, checksums of all runs and of the collapsed text."""
    def line(run: Column) -> Column:
        return F.concat_ws(",", run["start"], run["length"], run["period"])

    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"),
    )))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
