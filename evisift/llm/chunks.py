"""Questions that every document asks about the whole corpus, answered in a few rounds of shuffles.

Language-model counts and subword encodings have one form: a document holds millions of keys
(words, n-grams), the answer for a key depends on all documents or is dear to work out, and
the table of keys grows with the corpus, so it can't be broadcast. A join of single tokens
would shuffle a row per token. Here documents are gathered in chunks first:

1. each task packs its documents into chunks, already tokenised; a chunk is one compressed row;
2. each chunk asks once for each of its distinct keys, packed into one message for each key bucket;
3. keys meet in their bucket, where each distinct key is answered once;
4. answers return to their chunk, which then works its documents through from left to right.

Keys that a third of all tokens share cost one entry per chunk, not one per token, so no
bucket is hot. That holds for words and n-grams; where documents ask with shingles, a key costs
one entry for each document that has it. The memory of a step is that of one chunk, or of one bucket; the number of
buckets grows with the corpus. All branches use the same exchange of chunks, so texts are
tokenised once.

Messages stay in proportion to the corpus. A chunk never sends more than ``FAN_OUT`` of them: where there are
more buckets, a message is for a group of buckets. In the group, messages of about as many chunks are merged to a chunk of
their own, which again sends at most ``FAN_OUT``, and so on, like a radix sort; answers take the same way back. So a
corpus of any size sends ``FAN_OUT`` messages a chunk and level, and levels grow with its logarithm (one up to
12 GB, two up to 12 TB, three up to 12 PB). A message of some kB is the price of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import CHUNK_CHARS, chunked, give_back, packed, small_batches, unpacked

#: Characters of text whose keys share one bucket: with it a bucket stays at some MB.
BUCKET_CHARS = 12_000_000

#: Most messages of a chunk, and about as many messages that are merged on their way.
FAN_OUT = 1024

HELD, HELD_ARROW = "chunk string, bucket long, body binary", pa.schema([("chunk", pa.string()), ("bucket", pa.int64()), ("body", pa.binary())])
ASKED, ASKED_ARROW = "bucket long, chunk string, keys binary", pa.schema([("bucket", pa.int64()), ("chunk", pa.string()), ("keys", pa.binary())])

Arrays = dict[str, np.ndarray]
#: Of a chunk's body: for each set of keys, the bucket of each key, and the arrays with one entry for each key.
Deal = Callable[[Arrays], list[tuple[np.ndarray, Arrays]]]


def corpus_chars(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]


def ids_of(docs: pa.Table) -> Arrays:
    """The documents' ids, and which of them are null (0 stands in their place)."""
    ids = docs.column("doc_id")
    return {"ids": pc.fill_null(ids, 0).to_numpy(), "null_ids": pc.is_null(ids).to_numpy()}


def with_nulls(body: Arrays) -> pa.Array:
    """The ids as a column of the result."""
    return pa.array(body["ids"], pa.int64(), mask=body["null_ids"])


def chunk_name(partition: int, number: int, body: bytes) -> str:
    """Of its own for each chunk of a task, and the same for whichever attempt of the task packs the same documents."""
    return f"{partition}-{number}-{hashlib.blake2b(body, digest_size=12).hexdigest()}"


@dataclass(frozen=True)
class Route:
    """How messages reach their bucket: ``levels`` times one of ``fan`` lanes."""

    levels: int
    fan: int

    @classmethod
    def over(cls, buckets: int) -> Route:
        levels = 1
        while FAN_OUT**levels < buckets:
            levels += 1
        fan = 1
        while fan**levels < buckets:
            fan += 1
        return cls(levels, fan)

    @property
    def buckets(self) -> int:
        return self.fan**self.levels

    def dealt(self, body: Arrays, deal: Deal) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, Arrays]]:
        """Per set of keys: the order that sorts it by lane, where each lane begins, the buckets within lanes, the arrays."""
        out = []
        for bucket, arrays in deal(body):
            lane = bucket % self.fan
            order = np.argsort(lane, kind="stable")
            out.append((order, np.searchsorted(lane[order], np.arange(self.fan + 1)), bucket // self.fan, arrays))
        return out


def own_keys(ask: Callable[[Arrays], list[tuple[np.ndarray, Arrays]]], buckets: int) -> Deal:
    """The keys that documents ask for, by the number of each key."""
    return lambda body: [((number % np.uint64(buckets)).astype(np.int64), arrays) for number, arrays in ask(body)]


def merged_keys(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
    """The keys of merged messages, by what is left of their buckets."""
    sets = sorted(int(name.split(".")[0]) for name in body if name.endswith(".#"))
    return [
        (body[f"{k}.#"], {name.split(".", 1)[1]: x for name, x in body.items() if name.startswith(f"{k}.") and not name.endswith(".#")})
        for k in sets
    ]


def sent(holders: DataFrame, deal: Deal, route: Route, last: bool) -> DataFrame:
    """The messages of chunks, one for each lane. Before the last level they carry what is left of each key's bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                sets = route.dealt(unpacked(body.as_py()), deal)
                keys = [
                    packed(**{
                        f"{k}.{name}": array[order[begins[lane] : begins[lane + 1]]]
                        for k, (order, begins, rest, arrays) in enumerate(sets)
                        for name, array in (arrays if last else {**arrays, "#": rest}).items()
                    })
                    for lane in range(route.fan)
                ]
                lanes = [bucket * route.fan + lane for lane in range(route.fan)]
                yield pa.RecordBatch.from_pydict({"bucket": lanes, "chunk": [chunk] * route.fan, "keys": keys}, schema=ASKED_ARROW)
                del sets, keys
                give_back()

    return holders.select("chunk", "bucket", "body").mapInArrow(task, ASKED)


def merged(asked: DataFrame, level: int, blocks: int) -> DataFrame:
    """Messages of one group of buckets, merged to ``blocks`` chunks of their own."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")  # the same whichever way messages arrive
        bodies = [unpacked(x.as_py()) for x in group.column("keys")]
        body = {name: np.concatenate([x[name] for x in bodies]) for name in bodies[0]}
        for name in [n for n in body if n.endswith(".#")]:
            body[f"/{name.split('.')[0]}"] = np.array([len(x[name]) for x in bodies], np.int64)
        names = np.empty(group.num_rows, object)
        names[:] = group.column("chunk").to_pylist()
        bucket, block = group.column("bucket")[0].as_py(), group.column("block")[0].as_py()
        out = pa.table({
            "chunk": [f"{level}-{bucket}-{block}"], "bucket": [bucket], "body": [packed(**body, **{"/chunks": names})],
        }, schema=HELD_ARROW)
        give_back()
        return out

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(blocks)))
    return dealt.groupBy("bucket", "block").applyInArrow(merge, HELD)


def returned(replies: pa.Table, bucket: int, sets: list, fan: int) -> Arrays:
    """The answers to a chunk's messages, each array in the order of the keys asked."""
    lanes = sorted(zip(replies.column("bucket").to_pylist(), replies.column("keys")), key=lambda x: x[0])
    if [b for b, _ in lanes] != [bucket * fan + lane for lane in range(fan)]:
        raise ValueError("chunks differ between two readings of the documents: land the documents in a table first")
    bodies = [unpacked(x.as_py()) for _, x in lanes]
    out = {}
    for name in bodies[0]:
        got = np.concatenate([x[name] for x in bodies])
        out[name] = np.empty_like(got)
        out[name][sets[int(name.split(".")[0])][0]] = got
    return out


def delivered(holders: DataFrame, deal: Deal, route: Route, count: int, level: int = 1) -> DataFrame:
    """All messages at their buckets; ``count`` is about the number of chunks."""
    asked = sent(holders, deal, route, level == route.levels)
    if level == route.levels:
        return asked
    blocks = max(1, -(-count // FAN_OUT))
    return delivered(merged(asked, level, blocks), merged_keys, route, blocks, level + 1)


def answered(
    holders: DataFrame, deal: Deal, answer: Callable[[Iterable[Arrays]], Iterable[Arrays]], route: Route, count: int, level: int = 1,
    one_pass: bool = False,
) -> DataFrame:
    """The answers to all messages, back at the chunks that sent them: ``bucket, chunk, keys``."""
    asked = sent(holders, deal, route, level == route.levels)
    if level == route.levels:
        def answer_bucket(group: pa.Table) -> pa.Table:
            bodies = (unpacked(x.as_py()) for x in group.column("keys"))
            replies = answer(bodies if one_pass else list(bodies))
            out = pa.table({
                "bucket": group.column("bucket"), "chunk": group.column("chunk"),
                "keys": pa.array([packed(**x) for x in replies], pa.binary()),
            }, schema=ASKED_ARROW)
            del bodies, replies
            give_back()
            return out

        return asked.groupBy("bucket").applyInArrow(answer_bucket, ASKED)

    def part(holder: pa.Table, replies: pa.Table) -> pa.Table:
        body, bucket = unpacked(holder.column("body")[0].as_py()), holder.column("bucket")[0].as_py()
        whole = returned(replies, bucket, route.dealt(body, merged_keys), route.fan)
        names = body["/chunks"].tolist()
        cuts = {name: np.cumsum(body[f"/{name.split('.')[0]}"])[:-1] for name in whole}
        parts = {name: np.split(x, cuts[name]) for name, x in whole.items()}
        out = pa.table({
            "bucket": [bucket] * len(names), "chunk": names,
            "keys": pa.array([packed(**{name: x[i] for name, x in parts.items()}) for i in range(len(names))], pa.binary()),
        }, schema=ASKED_ARROW)
        give_back()
        return out

    blocks = max(1, -(-count // FAN_OUT))
    together = merged(asked, level, blocks)
    below = answered(together, merged_keys, answer, route, blocks, level + 1, one_pass)
    return together.groupBy("chunk").cogroup(below.groupBy("chunk")).applyInArrow(part, ASKED)


def ask_all(
    docs: DataFrame,
    pack: Callable[[pa.Table], Arrays],
    ask: Callable[[Arrays], list[tuple[np.ndarray, Arrays]]],
    answer: Callable[[Iterable[Arrays]], Iterable[Arrays]],
    finish: Callable[[Arrays, Callable[[str], np.ndarray]], pa.RecordBatch],
    schema: str,
    chars: int,
    columns: Sequence[str] = (),
    chunk_chars: int | None = None,
    one_pass: bool = False,
) -> DataFrame:
    """Run the four steps over ``docs(doc_id, text)``; ``chars`` is the size of the corpus.

    ``pack`` turns a table of documents, with further ``columns`` where asked for, into arrays. ``ask`` gives one item for each bucketed
    set of keys of a chunk: a number for each key, by which it finds its bucket,
    and the arrays with one entry for each key. ``answer`` gets what is asked in one
    bucket, in several parts, and returns arrays with one entry per key for each of them; it may not
    depend on how keys are dealt to parts; with ``one_pass`` it gets them one by one, each unpacked as it is asked for, and may give
    its own likewise, so that they need not be held together. ``finish`` gets the
    chunk and a function that returns an answer array in the order of the keys asked.
    """
    small_batches(docs.sparkSession)
    route = Route.over(max(1, int(chars) // BUCKET_CHARS))
    deal = own_keys(ask, route.buckets)

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, part in enumerate(chunked(batches, chars=chunk_chars or CHUNK_CHARS)):
            body = packed(**pack(part))
            yield pa.RecordBatch.from_pydict({"chunk": [chunk_name(partition, number, body)], "bucket": [0], "body": [body]}, schema=HELD_ARROW)

    def finish_chunk(bodies: pa.Table, replies: pa.Table) -> pa.Table:
        if bodies.num_rows != 1:
            raise ValueError("chunks differ between two readings of the documents: land the documents in a table first")
        body = unpacked(bodies.column("body")[0].as_py())
        found = returned(replies, 0, route.dealt(body, deal), route.fan)
        out = pa.Table.from_batches([finish(body, found.__getitem__)])
        give_back()
        return out

    chunks = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *columns)
        .mapInArrow(pack_task, HELD)
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    )
    answers = answered(chunks, deal, answer, route, 1 + int(chars) // (chunk_chars or CHUNK_CHARS), one_pass=one_pass)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish_chunk, schema)
