"""Quality classifier: a weak-label model, and a hashed linear scorer trained on its posteriors.

Two things are judged apart: low quality and toxicity. For each, several overlapping
labellers (heuristics over the text, and human labels where a document has one) vote *bad*
(1), *good* (-1) or nothing (0). Expectation-maximisation over the counts of vote patterns
estimates how far each labeller can be trusted, and with it the probability that a document
with a given pattern is bad. These posteriors are the training labels of a logistic model
over hashed words and votes, which scores every document.

What runs where: votes and scores are worked out in parallel over all documents and whole
texts; pattern counts cover all documents, and there are at most 3 ** labellers of them, so
they fit the driver whatever the corpus; the linear model is fitted on at most about
``sample_docs`` labelled documents, chosen by a hash of their id. The weights have a fixed
size (``SLOTS``).

Defined results: null or empty text has no words and is rejected as low quality; without
labels the human labeller abstains; several labels of a document count as bad if one is bad;
equal texts may differ only by their labels' vote, which is not a feature of the scorer, so
they get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import UPPER, chunked, one_array, small_batches, spaced_words, word_hashes

SLOTS = 2**18
#: Most labelled documents (about) that the linear scorer is fitted on.
SAMPLE_DOCS = 8_000
#: A hashed word takes part if it is in so many documents of the sample.
LEAST_DOCS = 5
THRESHOLD = 0.5
#: Characters of text in one chunk, of which all words are held at once.
CHARS = 1_000_000
#: Weight of the prior that a labeller is right, in its own votes; that of labellers named here differs.
TRUST = 0.2
TRUST_IN = {"human": 2.0, "toxic_human": 2.0}
#: First letters of a word that are a feature besides the whole word: inflected forms share them.
STEM = 5

#: Insults as whole words.
INSULTS = frozenset({"idiot", "moron", "loser", "clown", "pathetic", "stupid", "dumb", "scum", "trash", "worthless", "imbecile", "disgusting"})
SYMBOLS = b"#*$%&|<>{}\\~^="
CAPITALS = UPPER.encode()

QUALITY = ["symbols", "shouting", "few_distinct", "repeated_lines", "word_length", "human"]
TOXICITY = ["insults", "shouting", "toxic_human"]
TEXT_VOTES = ["symbols", "shouting", "few_distinct", "repeated_lines", "word_length", "insults"]

VOTES = pa.schema([("doc_id", pa.int64()), *((v, pa.int8()) for v in TEXT_VOTES)])
FEATURES = pa.schema([*VOTES, ("slots", pa.list_(pa.int32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("low_quality", pa.float64()), ("toxic", pa.float64())])


def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 1, np.where(good, -1, 0)).astype(np.int8)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; much faster on millions of them than a hash table."""
    ordered = np.sort(numbers)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def bytes_in(texts: pa.Array, wanted: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per text: bytes among ``wanted``, and all bytes."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    among = np.zeros(256, np.uint8)
    among[list(wanted)] = 1
    places = np.flatnonzero(among[data]) + offsets[0]
    return np.diff(np.searchsorted(places, offsets)), np.diff(offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text: the share of its lines with content that equal an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    full = pc.greater(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0)
    owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
    coded = lines.filter(full).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    found = distinct(owner.astype(np.int64) * size + coded.indices.to_numpy()) // size
    return 1 - np.bincount(found, minlength=len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


@dataclass(frozen=True)
class Words:
    """The words of a chunk: per document how many, and the distinct ones of each document."""

    counts: np.ndarray
    bare: list[str]  # the distinct words of the chunk without punctuation
    owner: np.ndarray  # of each distinct word of a document
    code: np.ndarray


def votes_of(part: pa.Table) -> tuple[dict[str, np.ndarray], Words]:
    """The votes of the text labellers on each document, and its words."""
    texts = pc.fill_null(one_array(part.column("text")), "")
    repeated = repeated_lines(texts)
    n_symbols, _ = bytes_in(texts, SYMBOLS)
    n_capitals, n_bytes = bytes_in(texts, CAPITALS)
    counts, codes, words = spaced_words(texts)
    n, size, listed = np.maximum(counts, 1), max(len(words), 1), words.to_pylist()
    owner = np.repeat(np.arange(len(counts)), counts)
    letters = np.array([len(w) for w in listed] or [0])
    pairs = distinct(owner.astype(np.int64) * size + codes)
    d_owner, d_code = pairs // size, pairs % size
    bare = [w if w.isalnum() else re.sub(r"\W+", "", w) for w in listed]
    insult = np.array([w in INSULTS for w in bare] or [False])
    insults = np.bincount(d_owner[insult[d_code]], minlength=len(counts))
    symbols, shouting = n_symbols / n, n_capitals / np.maximum(n_bytes, 1)
    variety = np.bincount(d_owner, minlength=len(counts)) / n
    mean = np.bincount(owner, weights=letters[codes] if len(codes) else None, minlength=len(counts)) / n
    votes = {
        "symbols": vote((symbols > 0.08) | (counts == 0), symbols == 0),
        "shouting": vote((shouting > 0.3) & (counts > 3), shouting < 0.1),
        "few_distinct": vote((variety < 0.35) & (counts > 20), variety > 0.45),
        "repeated_lines": vote(repeated > 0.25, repeated == 0),
        "word_length": vote((mean > 9) | (mean < 2.8), (mean > 3.5) & (mean < 7)),
        "insults": vote(insults > 0, np.zeros(len(counts), bool)),  # other languages have other insults
    }
    return votes, Words(counts, bare, d_owner, d_code)


def featured(part: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Votes per document; then owner and slot of each distinct hashed word of a document; words per document."""
    votes, words = votes_of(part)
    if not words.bare:
        return votes, np.empty(0, np.int64), np.empty(0, np.int64), words.counts
    forms = [words.bare, ["^" + w[:STEM] for w in words.bare]]
    slots = [(word_hashes(pa.array(x, pa.string())) % np.uint64(SLOTS)).astype(np.int64) for x in forms]
    pairs = distinct(np.concatenate([words.owner * SLOTS + s[words.code] for s in slots]))
    return votes, pairs // SLOTS, pairs % SLOTS, words.counts


def text_votes(docs: DataFrame) -> DataFrame:
    """The votes of the text labellers on every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, chars=CHARS):
            votes, _ = votes_of(part)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").combine_chunks(), **votes}, schema=VOTES)

    return narrow(docs).mapInArrow(run, spark_schema(VOTES))


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int8(): "tinyint", pa.float64(): "double", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def human_votes(labels: DataFrame) -> DataFrame:
    """One row per labelled document; one bad label outweighs good ones."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        F.coalesce(F.max(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, -1)), F.lit(0)).cast("tinyint").alias("human"),
        F.coalesce(F.max(F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, -1)), F.lit(0)).cast("tinyint").alias("toxic_human"),
    )


def with_human(votes: DataFrame, labels: DataFrame) -> DataFrame:
    human = human_votes(labels)
    joined = votes.join(human, votes["doc_id"] == human["_doc"], "left").drop("_doc")
    return joined.fillna(0, ["human", "toxic_human"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: Sequence[str] = (), rounds: int = 60) -> np.ndarray:
    """Probability of *bad* for each vote pattern. ``patterns``: one row each, entries -1, 0, 1.

    Labellers are taken as independent given the truth; each has a table of vote
    probabilities for bad and for good documents. Prior: a labeller is right more often than
    not, which counts as much as ``TRUST`` times its own votes, or ``TRUST_IN`` times for those of
    the given names that it lists. Start: the share of bad votes, weighted likewise.
    """
    if not len(patterns):
        return np.empty(0)
    weight = np.array([TRUST_IN.get(name, TRUST) for name in labellers] or [TRUST] * patterns.shape[1])
    right = [counts @ (patterns == v) * weight for v in (1, -1)]
    bad_votes, good_votes = ((patterns == v) @ weight for v in (1, -1))
    bad = (bad_votes + 0.1) / (bad_votes + good_votes + 0.2 + patterns.shape[1] * 0.1)
    choices = np.stack([patterns == v for v in (-1, 0, 1)])
    for _ in range(rounds):
        logs = []
        for share, vote_right, trusted in ((bad, 2, right[0]), (1 - bad, 0, right[1])):
            mass = counts * share
            table = np.einsum("p,vpl->vl", mass, choices) + 1.0
            table[vote_right] += trusted
            table /= table.sum(0)
            logs.append(np.log(mass.sum() + 1.0) + np.einsum("vl,vpl->p", np.log(table), choices))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        if np.abs(new - bad).max() < 1e-6:
            break
        bad = new
    return bad


def design(votes: dict[str, np.ndarray], owner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and slot of all features of documents: their hashed words and their votes, present or not."""
    v_owner, v_slot = vote_features(votes)
    return np.concatenate([owner, v_owner]), np.concatenate([slot, v_slot])


def margins(weights: np.ndarray, owner: np.ndarray, slot: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(owner, weights=weights[slot], minlength=docs) + weights[-1]


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(owner: np.ndarray, slot: np.ndarray, target: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on presence features; the last weight is the constant.

    Starts from each feature's log-odds, drawn to none by two documents as expected in either
    class, and goes on with Adagrad.
    """
    size, n = SLOTS + len(TEXT_VOTES) * 2 + 1, max(len(target), 1)
    share = target.mean() if len(target) else 0.5
    bad, every = np.bincount(slot, weights=target[owner], minlength=size), np.bincount(slot, minlength=size)
    weights = np.log((bad + 2) / (every * share + 2)) - np.log((every - bad + 2) / (every * (1 - share) + 2))
    weights[-1] = np.log((share * n + 1) / ((1 - share) * n + 1))
    gained = np.full(size, 1e-6)
    for _ in range(rounds):
        miss = logistic(margins(weights, owner, slot, len(target))) - target
        gradient = np.bincount(slot, weights=miss[owner], minlength=size) / n + ridge * weights / n
        gradient[-1] = miss.mean() if len(target) else 0.0
        gained += gradient**2
        weights -= 0.1 * gradient / np.sqrt(gained)
    return weights


def vote_features(votes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Votes of bad and of good as features behind the hashed words."""
    owners, slots = [], []
    for k, name in enumerate(TEXT_VOTES):
        for sign, v in enumerate((1, -1)):
            met = np.flatnonzero(np.asarray(votes[name]) == v)
            owners.append(met.astype(np.int32))
            slots.append(np.full(len(met), SLOTS + 2 * k + sign, np.int32))
    return np.concatenate(owners), np.concatenate(slots)


def sample_features(docs: DataFrame, labels: DataFrame, sample_docs: int) -> pa.Table:
    """Votes and hashed words of about ``sample_docs`` labelled documents (all, if there are fewer)."""
    human = human_votes(labels)
    share = min(1.0, sample_docs / max(human.count(), 1))
    bound = min(2**63 - 1, int((share - 0.5) * 2**64))  # of 64-bit hashes, so that no share rounds to none
    chosen = human.filter(F.xxhash64("_doc") <= bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, chars=CHARS):
            votes, owner, slot, _ = featured(part)
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
            slots = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slot, pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").combine_chunks(), **votes, "slots": slots}, schema=FEATURES)

    picked = narrow(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"), "left_semi")  # bounded by sample_docs
    features = with_human(picked.mapInArrow(run, spark_schema(FEATURES)), labels)
    return features.toArrow().sort_by("doc_id")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the two linear scorers: low quality, toxicity."""
    small_batches(docs.sparkSession)
    votes = with_human(text_votes(docs), labels)
    counted = votes.groupBy(*dict.fromkeys(QUALITY + TOXICITY)).count().withColumnRenamed("count", "n")
    patterns = counted.toPandas()  # at most 3 ** labellers rows
    sample = sample_features(docs, labels, sample_docs)
    lists = sample.column("slots").combine_chunks()
    owner = np.repeat(np.arange(sample.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    slot = lists.flatten().to_numpy()
    common = np.bincount(slot, minlength=SLOTS)[slot] >= LEAST_DOCS
    features = design({v: sample.column(v).to_numpy() for v in TEXT_VOTES}, owner[common], slot[common])
    weights = []
    for labellers in (QUALITY, TOXICITY):
        grouped = patterns.groupby(labellers, as_index=False)["n"].sum().sort_values(labellers)
        bad = expectation_maximisation(grouped[labellers].to_numpy(int), grouped["n"].to_numpy(float), labellers)
        known = dict(zip(map(tuple, grouped[labellers].to_numpy(int).tolist()), bad))
        target = np.array([known[row] for row in zip(*(sample.column(v).to_pylist() for v in labellers))])
        weights.append(fit(*features, target))
    return weights[0], weights[1]


def scorer(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """A function from a table of documents to words, low quality and toxicity per document."""
    weights = np.stack(train(docs, labels, sample_docs)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def scores(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        votes, owner, slot, counts = featured(part)
        features = design(votes, owner, slot)
        low, toxic = (logistic(margins(w, *features, len(counts))) for w in sent.value.astype(float))
        return counts, np.where(counts == 0, 1.0, low), toxic

    return scores


def score(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, n_words, low_quality, toxic, kept`` of every document; the two scores from 0 to 1."""
    scores = scorer(docs, labels, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, chars=CHARS):
            counts, low, toxic = scores(part)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").combine_chunks(), "n_words": counts.astype(np.int64),
                "low_quality": low, "toxic": toxic,
            }, schema=SCORES)

    scored = narrow(docs).mapInArrow(run, spark_schema(SCORES))
    return scored.withColumn("kept", (F.col("low_quality") < THRESHOLD) & (F.col("toxic") < THRESHOLD))


def good_documents(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that the classifier keeps, with all their columns unchanged."""
    scores = scorer(docs, labels, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, chars=CHARS):
            _, low, toxic = scores(part)
            yield from part.filter(pa.array((low < THRESHOLD) & (toxic < THRESHOLD))).to_batches()

    return docs.mapInArrow(run, docs.schema)
