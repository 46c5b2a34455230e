"""Language-model scores from a weighted backoff automaton.

The model is a smoothed bigram model over all training documents. As an automaton it has a
root and a state for each word that was seen as a history:

* an arc (state h, word w) for each bigram seen, with log10 of
  ``(c(h, w) + m * p(w)) / (c(h) + m)``;
* a failure arc from h to the root with weight log10 of ``m / (c(h) + m)``;
* an arc at the root for every word with log10 of ``p(w) = (c(w) + 1) / (N + V + 1)``, which
  leaves one share for unknown words.

A text is read once from left to right: the state is carried, and the weights of the arcs
taken are summed up. The automaton grows with the corpus, so it is never in one place: each
chunk of documents gets the part of it that its own bigrams can reach (``chunks``).

Tokens are the words between ASCII white space, ASCII lower-cased, and an end after each text.
Defined results: null or empty text is the end alone; without any training document every
token is unknown. Equal texts get equal scores.
A null doc_id is held out or not as one and the same id; each such row has its own result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import chunks
from evisift.llm.chunks import Arrays
from evisift.llm.common import chunked, mixed, packed, spaced_words, unpacked, word_hashes

#: Documents whose crc32 modulo FOLDS is HELD are not learned from.
FOLDS, HELD = 7, 2
#: Weight of the unigram estimate in each history, in tokens.
BACKOFF_MASS = 100.0
#: Hash of the end of a text; a random constant, so that no word is likely to share it.
END = np.uint64(0xD1B54A32D192ED03)

SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, n_backoffs long"
)
SCORES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_backoffs", pa.int64()),
])


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD for i in doc_ids], bool)


def pack(docs: pa.Table) -> Arrays:
    """Token codes per document; the last code is the end."""
    ids = chunks.ids_of(docs)
    counts, codes, words = spaced_words(docs.column("text"))
    hashes = np.append(word_hashes(words), END)
    ends = np.cumsum(counts) + np.arange(len(counts))
    tokens = np.empty(len(codes) + len(counts), np.int32)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside], tokens[ends] = codes, len(hashes) - 1
    held = held_out(docs.column("doc_id").to_pylist())
    return {**ids, "counts": counts + 1, "tokens": tokens, "hashes": hashes, "held": held}


def bigrams(body: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams of the chunk as history * words + word, and how often each occurs in training texts.

    The history of a text's first token is the end of the text before.
    """
    tokens, words = body["tokens"].astype(np.int64), len(body["hashes"])
    history = np.empty_like(tokens)
    if len(tokens):
        history[0], history[1:] = words - 1, tokens[:-1]
    learned = ~np.repeat(body["held"], body["counts"])
    distinct, which = np.unique(history * words + tokens, return_inverse=True)
    return distinct, np.bincount(which, weights=learned, minlength=len(distinct)).astype(np.int32)


def unigrams(body: Arrays) -> np.ndarray:
    learned = ~np.repeat(body["held"], body["counts"])
    return np.bincount(body["tokens"], weights=learned, minlength=len(body["hashes"])).astype(np.int32)


def ask(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
    hashes = body["hashes"]
    pairs, counts = bigrams(body)
    left, right = pairs // len(hashes), pairs % len(hashes)
    keys = mixed(hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right], 2)
    return [(hashes, {"key": hashes, "count": unigrams(body)}), (keys, {"key": keys, "count": counts})]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of keys, the counts of its keys over all lists."""
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    return np.split(total[which], np.cumsum([len(x) for x in keys])[:-1])


def answer(asked: list[Arrays]) -> list[Arrays]:
    ones, twos = ([*summed([x[f"{k}.key"] for x in asked], [x[f"{k}.count"] for x in asked])] for k in (0, 1))
    return [{"0.count": a, "1.count": b} for a, b in zip(ones, twos)]


def train_totals(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training documents; a chunk gives one row for each of its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches):
            body = pack(part)
            seen = unigrams(body)
            yield pa.RecordBatch.from_pydict({
                "word": body["hashes"][seen > 0].view(np.int64), "n": seen[seen > 0].astype(np.int64),
            })

    words = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )
    total = words.agg(F.sum("n"), F.count("*")).first()
    return total[0] or 0, total[1]


class Automaton:
    """The part of the backoff automaton that a chunk can reach.

    States are the chunk's word codes; the root is implied by the failure arcs, since every
    failure leads to it and a root arc of word w leads to state w.
    """

    def __init__(self, ones: np.ndarray, pairs: np.ndarray, twos: np.ndarray, total: int, distinct: int, mass: float):
        words = len(ones)
        prior = (ones + 1.0) / (total + distinct + 1.0)
        self.words = words
        self.root = np.log10(prior).tolist()
        self.fail = np.where(ones > 0, np.log10(mass / (ones + mass)), 0.0).tolist()
        seen = twos > 0
        left, right = pairs[seen] // words, pairs[seen] % words
        weights = np.log10((twos[seen] + mass * prior[right]) / (ones[left] + mass))
        self.arcs = dict(zip(pairs[seen].tolist(), weights.tolist()))

    def score(self, tokens: list[int]) -> tuple[float, int]:
        """Log10 probability of a text, and the number of failure arcs taken."""
        arcs, words, root, fail = self.arcs, self.words, self.root, self.fail
        state, total, failures = words - 1, 0.0, 0
        for token in tokens:
            weight = arcs.get(state * words + token)
            if weight is None:
                total += fail[state] + root[token]
                failures += 1
            else:
                total += weight
            state = token
        return total, failures


def score(docs: DataFrame, mass: float = BACKOFF_MASS) -> DataFrame:
    """Score every document of ``docs(doc_id, text)``; learn from those that are not held out."""
    chars = chunks.corpus_chars(docs)
    total, distinct = train_totals(docs)

    def finish(body: Arrays, reply) -> pa.RecordBatch:
        pairs, _ = bigrams(body)
        ones, twos = reply("0.count"), reply("1.count")
        model = Automaton(ones, pairs, twos, total, distinct, mass)
        tokens, ends = body["tokens"], np.cumsum(body["counts"])
        starts = ends - body["counts"]
        known = np.concatenate([[0], np.cumsum(ones[tokens] > 0)])
        base = np.log10(ones + 1.0)[tokens]
        listed = tokens.tolist()
        scored = [model.score(listed[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        n = body["counts"].astype(np.int64)
        sums = np.add.reduceat(base, starts) if len(starts) else np.empty(0)
        return pa.RecordBatch.from_pydict({
            "doc_id": chunks.with_nulls(body), "held_out": body["held"], "n_tokens": n, "n_known": known[ends] - known[starts],
            "train_tokens": np.full(len(n), total, np.int64), "base_score": sums - n * np.log10(total + distinct + 1.0),
            "score": [s for s, _ in scored], "n_backoffs": [k for _, k in scored],
        }, schema=SCORES_ARROW)

    return chunks.ask_all(docs, pack, ask, answer, finish, SCORES, chars)
