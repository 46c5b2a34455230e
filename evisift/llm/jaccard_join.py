"""Exact n-gram Jaccard join in the metric space of shingle sets (distance = 1 - similarity).

Two texts link when ``100 * common >= 75 * all`` of their distinct 5-word shingles, that is
when their distance is at most r = 0.25. The join is exact. Steps:

1. *Which texts can link at all.* Of the half of n shingles with the smallest hashes, n / 4 are also
   in that half of any linked text. Every text asks which of these occur in another text (``chunks``); then, among the texts left, whether three quarters of *all* its
   shingles do. A text that fails either is at a distance over r from every other one. Texts
   with the same set count once.
2. *Pivots and regions.* Texts with the same smallest shingle under one of several hash
   functions form a region around the region's first text, its pivot; linked texts
   share a region of one function with a chance of three quarters or more. The pivot with which
   a text shares the most regions is taken as its nearest: its Voronoi region. The exact
   distance to it is measured, and links to pivots join texts into components.
3. *Boundaries.* What is left are links between different components. Two linked texts share one
   of the n - ceil(0.75 n) + 1 rarest shingles of either, so the texts of every such shingle that
   still spans several components are brought together: a text on the boundary of several
   regions is replicated to each of them. Few pairs across components are measured one by
   one, unless their distances to a common pivot differ by more than r. Many are joined
   recursively: a pivot is measured against all, and the others are split at a distance m from it into two regions, of which the outer one
   also gets the texts within r inside the boundary. By the triangle inequality no link is
   lost. Regions whose texts are of one component are done.

A region of more than ``block`` texts is dealt into pairs of blocks, one task each, so that no
task holds an unbounded region; none of it is dropped.

Defined results: texts without words (or null) link with nothing; with fewer than 5 words the
whole sequence is the one shingle. The result has a row for every row. An id may have several texts: each links for itself
and has the smallest id of the texts it is linked with, its own included. A row with a null doc_id has the component
of the texts with the same set of shingles, else a null one, and links no others. Other columns are ignored, whatever their
names. A very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.llm import chunks
from evisift.llm.chunks import Arrays
from evisift.llm.common import (
    SIMILAR_PERCENT, free_name, give_back, mixed, one_array, packed, spaced_words, text_shingles, unpacked, with_partners, word_hashes,
)
from evisift.llm.components import components
from evisift.session import written

#: Hash functions whose smallest shingles make regions.
PIVOT_FUNCTIONS = 4
#: Shingles that one bucket counts, and about how many a message's sender holds.
BUCKET_SHINGLES, PORTION_SHINGLES = 1_000_000, 400_000
#: Characters of text in one chunk. No keys are told apart inside a chunk, so small ones cost no shuffle.
CHARS = 1_500_000
#: Most texts of a region in one task, before it is dealt into blocks.
BLOCK = 2_000
#: Pairs across components for each text of a block, up to which a region compares single pairs.
PAIRS_PER_TEXT = 10

SETS = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, shingles array<long>, anchors array<long>"
SETS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
    ("shingles", pa.list_(pa.int64())), ("anchors", pa.list_(pa.int64())),
])


def prefix_rule(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the smallest of n shingles to look at, and how many of these any linked text looks at too.

    Of two linked texts with n <= m shingles, c >= percent * m / 100 are common. The j-th common one is
    at most at place j + n - c of one and j + m - c of the other, so inside the first half of both
    for every j up to c - m / 2, which is (percent - 50) * m / 100 or more.
    """
    lacking = n - -(-percent * n // 100)
    length = np.minimum(np.maximum(-(-n // 2), lacking + 1), n)
    return length, np.maximum(-(-(percent - 50) * n // 100), 1)


def distinct_sets(shingles: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, text after text, and how many each text has; ``owner`` is in order."""
    shingles = shingles.copy()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))]).tolist()
    for start, end in zip(bounds, bounds[1:]):
        if end - start > 1:
            shingles[start:end].sort()
    first = np.ones(len(shingles), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[first], np.bincount(owner[first], minlength=texts)


def pack(part: pa.Table) -> Arrays:
    counts, codes, words = spaced_words(part.column("text"))
    # as Spark's xxhash64 of the text
    texts = [xxhash.xxh64_intdigest(t, seed=42) for t in one_array(pc.fill_null(one_array(part.column("text")), "")).cast(pa.binary()).to_pylist()]
    return {**chunks.ids_of(part), "texts": np.array(texts, np.uint64), "counts": counts, "codes": codes, "hashes": word_hashes(words)}


def sets_of(body: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Made once for each unpacked chunk, which keeps them."""
    if "shingles" not in body:
        hashes = body["hashes"][body["codes"]]
        body["shingles"], body["sizes"] = distinct_sets(*text_shingles(hashes, body["counts"]), len(body["counts"]))
    return body["shingles"], body["sizes"]


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of consecutive groups."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def shingle_sets(docs: DataFrame, percent: int) -> DataFrame:
    """Per document: size and identity of its set; the set itself where some prefix shingle is common."""
    chars = chunks.corpus_chars(docs)

    def prefix(sizes: np.ndarray) -> np.ndarray:
        return ranks(sizes) < np.repeat(prefix_rule(sizes, percent)[0], sizes)

    def ask(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
        shingles, sizes = sets_of(body)
        keys = shingles[prefix(sizes)]
        return [(keys, {"key": keys})]

    def answer(asked: list[Arrays]) -> list[Arrays]:
        lists = [x["0.key"] for x in asked]
        _, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        common = (counts > 1)[which]
        return [{"0.common": x} for x in np.split(common, np.cumsum([len(x) for x in lists])[:-1])]

    def finish(body: Arrays, reply) -> pa.RecordBatch:
        shingles, sizes = sets_of(body)
        texts = len(sizes)
        owner = np.repeat(np.arange(texts), sizes)
        common = np.zeros(len(shingles), bool)
        common[prefix(sizes)] = reply("0.common")
        shared = (np.bincount(owner[common], minlength=texts) >= prefix_rule(sizes, percent)[1]) & (sizes > 0)
        identity = [np.zeros(texts, np.uint64) for _ in range(2)]
        for seed, total in enumerate(identity):
            np.add.at(total, owner, mixed(shingles, 101 + seed))
        kept = shared[owner]
        kept_sizes = np.where(shared, sizes, 0)
        starts = (np.cumsum(kept_sizes) - kept_sizes)[shared]
        anchors = np.zeros((int(shared.sum()), PIVOT_FUNCTIONS), np.uint64)
        for k in range(PIVOT_FUNCTIONS):
            anchors[:, k] = np.minimum.reduceat(mixed(shingles[kept], 201 + k), starts) if len(starts) else 0
        return pa.RecordBatch.from_arrays([
            chunks.with_nulls(body), pa.array(body["texts"].view(np.int64)), pa.array(sizes.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in identity),
            listed(shingles[kept].view(np.int64), kept_sizes),
            listed(anchors.reshape(-1).view(np.int64), np.where(shared, PIVOT_FUNCTIONS, 0)),
        ], schema=SETS_ARROW)

    return chunks.ask_all(docs, pack, ask, answer, finish, SETS, chars, chunk_chars=CHARS)


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))


def mostly_common(sets: DataFrame, percent: int) -> DataFrame:
    """The sets of which enough shingles occur in another set; ``sets(doc_id, n_shingles, shingles)`` are distinct sets."""
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    route = chunks.Route.over(1 + total // BUCKET_SHINGLES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, (lists, ids) in enumerate(portions(batches)):
            keys = lists.flatten().to_numpy().view(np.uint64)
            body = packed(key=keys, id=np.repeat(ids.to_numpy(), lists.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_pydict({
                "chunk": [chunks.chunk_name(partition, number, body)], "bucket": [0], "body": [body],
            }, schema=chunks.HELD_ARROW)

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListArray, pa.Array]]:
        for batch in batches:
            sizes = batch.column("shingles").value_lengths().to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PORTION_SHINGLES, prepend=0)).tolist()
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if end > start:
                    part = batch.slice(start, end - start)
                    yield part.column("shingles"), part.column("doc_id")

    def count(group: pa.Table) -> pa.Table:
        bodies = [unpacked(x.as_py()) for x in group.column("keys")]
        _, which, counts = np.unique(np.concatenate([b["0.key"] for b in bodies]), return_inverse=True, return_counts=True)
        ids, n = np.unique(np.concatenate([b["0.id"] for b in bodies])[counts[which] > 1], return_counts=True)
        del bodies, which, counts
        give_back()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    deal = chunks.own_keys(lambda body: [(body["key"], body)], route.buckets)
    holders = sets.select("doc_id", "shingles").mapInArrow(pack, chunks.HELD)
    common = (
        chunks.delivered(holders, deal, route, 1 + total // PORTION_SHINGLES)
        .groupBy("bucket").applyInArrow(count, "doc_id long, n long")
        .groupBy("doc_id").agg(F.sum("n").alias("n_common"))
    )
    return sets.join(common, "doc_id").filter(F.lit(100) * F.col("n_common") >= F.lit(percent) * F.col("n_shingles")).drop("n_common")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(doc_id, pivot)`` with the numbers of common and of all shingles."""
    pivots = sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("_pivot_set"))
    both = pairs.join(sets.select("doc_id", "shingles"), "doc_id").join(pivots, "pivot")
    common = F.size(F.array_intersect("shingles", "_pivot_set")).cast("long")
    return both.select("doc_id", "pivot", common.alias("common"), (F.size("shingles") + F.size("_pivot_set") - common).alias("whole"))


def pivot_regions(sets: DataFrame) -> DataFrame:
    """Each set with the pivot nearest to it and the distance: ``doc_id, pivot, common, whole``."""
    seats = sets.select("doc_id", F.posexplode("anchors").alias("function", "anchor"))
    pivots = seats.groupBy("function", "anchor").agg(F.min("doc_id").alias("pivot"))
    shared = seats.join(pivots, ["function", "anchor"]).filter("doc_id <> pivot").groupBy("doc_id", "pivot").count()
    nearest = shared.groupBy("doc_id").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("pivot"))
    return measured(nearest, sets)


def linked(measures: DataFrame, percent: int) -> DataFrame:
    return measures.filter(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("whole"))


def labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with ``label``, the smallest doc_id of the component that ``links(a, b)`` make."""
    return sets.join(components(links), F.col("doc_id") == F.col("node"), "left").withColumn(
        "label", F.coalesce("label", "doc_id")
    ).drop("node")


def rarest_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id, seat``: of each set of ``sets(doc_id, shingles)`` the n - ceil(percent * n / 100) + 1 shingles that
    occur in the fewest of the sets, without those that occur in no other.

    Two linked sets have one of them in common. A line that very many texts share is among the
    last, so it brings no texts together that have nothing else in common.
    """
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("seat"))
    held = each.groupBy("seat").agg(F.count("*").alias("sets"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sets", "seat"))
    ranked = each.join(held, "seat").withColumn("place", place)
    return ranked.filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("sets") > 1)).select("doc_id", "seat")


def boundary_seats(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Who stands on a boundary: ``doc_id, label, n, pivot, distance, seat`` for each of the rarest shingles of
    ``sets``; and the regions (shingles) whose texts are of several components, with the number of pairs across and
    the component ``around`` which they are, the one with most of their texts.
    """
    about = sets.select("doc_id", "label", F.size("shingles").alias("n"), "pivot", "distance")
    seats = written(rarest_shingles(sets, percent).join(about, "doc_id"), "seats")
    counted = seats.groupBy("seat", "label").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(38)")).alias("sum"), F.bit_xor(F.xxhash64("doc_id")).alias("xor")
    )
    regions = counted.groupBy("seat").agg(
        F.sum("c").alias("size"), F.count("*").alias("labels"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("across"),
        F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"), F.max_by("label", F.struct("c", "label")).alias("around"),
    ).filter("labels > 1")
    # several hashes often gather the same texts: one of them is enough
    alike = ["size", "labels", "across", "around", "sum", "xor"]
    return seats, regions.groupBy(*alike).agg(F.min("seat").alias("seat")).drop("sum", "xor")


def may_link(percent: int):
    """Sizes that allow the similarity, and distances to a common pivot that differ by the radius at most."""
    near = F.abs(F.col("distance") - F.col("_distance")) <= 1 - percent / 100 + 1e-9
    return (
        (F.lit(100) * F.least("n", "_n") >= F.lit(percent) * F.greatest("n", "_n"))
        & ((F.col("pivot") != F.col("_pivot")) | near | F.col("pivot").isNull() | F.col("_pivot").isNull())
    )


def crossing_pairs(seats: DataFrame, regions: DataFrame, percent: int) -> DataFrame:
    """Pairs of texts of different components in these regions, each pair once: ``doc_id, pivot``."""
    mine = seats.join(regions.select("seat"), "seat")
    others = mine.select("seat", *(F.col(c).alias(f"_{c}") for c in ("doc_id", "label", "n", "pivot", "distance")))
    pairs = mine.join(others, "seat").filter((F.col("doc_id") < F.col("_doc_id")) & (F.col("label") != F.col("_label")) & may_link(percent))
    return pairs.select("doc_id", F.col("_doc_id").alias("pivot")).distinct()


def joined_regions(seats: DataFrame, regions: DataFrame) -> DataFrame:
    """The texts of these regions, each once in a region: ``doc_id, label, joined, region, size``.

    Near copies of one text share many seats, so their regions have the same texts over and over. The regions around one
    component are joined to one region, unless that makes more pairs of texts than all of them have. A region that stays alone has
    the number of its seat.
    """
    members = seats.join(regions.select("seat", "around", "size"), "seat").select("doc_id", "label", "seat", "around", "size")
    apart = regions.groupBy("around").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"))
    union = members.select("around", "doc_id").distinct().groupBy("around").agg(F.count("*").alias("texts"))
    ways = union.join(apart, "around").select("around", "texts", (F.col("texts").cast("double") * F.col("texts") <= F.col("apart")).alias("joined"))
    return members.join(ways, "around").select(
        "doc_id", "label", "joined", F.when(F.col("joined"), F.col("around")).otherwise(F.col("seat")).alias("region"),
        F.when(F.col("joined"), F.col("texts")).otherwise(F.col("size")).alias("size"),
    ).distinct()


def boundary_links(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between different components of ``sets(doc_id, shingles, label, pivot, distance)``, enough to join them all: ``a, b``.

    Regions with few pairs across components compare these pairs, each once however many
    regions have it; the others are joined region by region, those around one component together.
    """
    seats, found = boundary_seats(sets, percent)
    regions = written(found, "regions")
    pairs = crossing_pairs(seats, regions.filter(F.col("across") <= block * PAIRS_PER_TEXT), percent)
    few = linked(measured(pairs, sets), percent).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    members = joined_regions(seats, regions.filter(F.col("across") > block * PAIRS_PER_TEXT)).withColumn(
        "blocks", F.ceil(F.col("size") / block).cast("int")
    ).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # block i meets block j in task (i, j), i <= j; with one block that is the region itself
    tasks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc_id", "label", "joined", "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    ).distinct()
    with_sets = tasks.join(sets.select("doc_id", "shingles"), "doc_id")

    def join_region(group: pa.Table) -> pa.Table:
        lists = group.column("shingles").combine_chunks()
        found = RegionJoin(
            group.column("doc_id").to_numpy(), group.column("label").to_numpy(), lists.flatten().to_numpy(),
            lists.value_lengths().to_numpy(), percent,
        ).links()
        del lists
        give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return few.union(with_sets.groupBy("joined", "region", "i", "j").applyInArrow(join_region, "a long, b long"))


class RegionJoin:
    """The links of a region that join its components, by pivots and triangle-inequality windows.

    ``holders`` lists the texts of each distinct shingle, so a pivot is measured by those that share shingles with it.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, percent: int):
        self.ids, self.percent, self.sizes = ids, percent, sizes
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(shingles, kind="stable")
        new = np.diff(shingles[order], prepend=0) != 0
        new[:1] = True
        self.codes = np.empty(len(shingles), np.int32)
        self.codes[order] = np.cumsum(new) - 1
        self.holders = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        self.begins = np.append(np.flatnonzero(new), len(shingles))
        self.parent = np.unique(labels, return_inverse=True)[1]
        self.found: list[tuple[int, int]] = []

    def links(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.ids))]
        while todo:
            members = todo.pop()
            _, label, counts = np.unique(self.parent[members], return_inverse=True, return_counts=True)
            if len(counts) < 2:
                continue
            rarest = int(np.argmin(counts[label]))  # texts of one large component need no pivot among themselves
            pivot, rest = members[rarest], np.delete(members, rarest)
            common, whole = self.measure(pivot, rest)
            for other in rest[100 * common >= self.percent * whole]:
                self.unite(pivot, other)
            distance = 1 - common / whole
            radius = 1 - self.percent / 100 + 1e-9
            middle = np.median(distance)
            inner, outer = rest[distance <= middle], rest[distance >= middle - radius]
            if len(inner) + len(outer) <= 1.4 * len(rest) and len(outer) < len(rest):
                todo += [inner, outer]
            else:
                todo.append(rest)
        return self.found

    def measure(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common and all shingles of the pivot and each other, some ``PORTION_SHINGLES`` at a time."""
        mine = self.codes[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]
        first, n = self.begins[mine], self.begins[mine + 1] - self.begins[mine]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // PORTION_SHINGLES, prepend=0))
        common = np.zeros(len(self.ids), np.int64)
        for begin, size in zip(np.split(first, cuts), np.split(n, cuts)):
            place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            common += np.bincount(self.holders[place], minlength=len(self.ids))
        return common[others], self.sizes[others] + self.sizes[pivot] - common[others]

    def unite(self, a: int, b: int) -> None:
        if self.parent[a] != self.parent[b]:
            self.found.append((int(self.ids[a]), int(self.ids[b])))
            self.parent[self.parent == self.parent[b]] = self.parent[a]


SAME_SET = ["set_a", "set_b", "n_shingles"]


def classes(docs: DataFrame, percent: int = SIMILAR_PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    The join works on distinct sets, so copies cost nothing and an id may have several texts: a set is known by its
    ``node``, and a component of sets gets the smallest id of all its rows.
    """
    sets = written(shingle_sets(docs, percent), "sets")
    firsts = written(
        sets.filter("n_shingles > 0").groupBy(*SAME_SET).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        .filter("first IS NOT NULL").withColumn("node", F.xxhash64(*SAME_SET)), "firsts",
    )
    candidates = sets.filter(F.size("shingles") > 0).select(
        "doc_id", F.xxhash64(*SAME_SET).alias("node"), "n_shingles", "shingles", "anchors"
    )
    # of each set, the rows of its first id; dealt by both, so no set's copies meet
    picked = candidates.join(firsts.select(F.col("first").alias("doc_id"), "node"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node"])
    distinct = picked.select(F.col("node").alias("doc_id"), "n_shingles", "shingles", "anchors")
    near = written(mostly_common(distinct, percent), "near")
    measures = written(pivot_regions(near), "measures")
    pivot_links = linked(measures, percent).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    placed = measures.select("doc_id", "pivot", (1 - F.col("common") / F.col("whole")).alias("distance"))
    regions = written(labelled(near.select("doc_id", "shingles").join(placed, "doc_id", "left"), pivot_links), "regions")
    more = boundary_links(regions, percent, block)
    labels = components(pivot_links.union(more))
    grouped = labels.join(firsts.select("node", "first"), "node")
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component"))
    linked_sets = grouped.join(smallest, "label").select("node", "component")
    per_set = written(firsts.join(linked_sets, "node", "left").select(
        *SAME_SET, "copies", F.coalesce("component", "first").alias("component")
    ), "classes")
    whole = sets.select("doc_id", "text_hash", *SAME_SET)
    return with_partners(whole, per_set, SAME_SET, "copies").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def join(docs: DataFrame, percent: int = SIMILAR_PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    return classes(docs, percent, block).drop("text_hash")


def one_of_each(docs: DataFrame, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns unchanged.

    Rows go by their id and text together: where an id has several texts, one may go and another stay. A row with a null id
    goes where its text has a group, as none of its texts is the group's smallest id.
    """
    doc, text = free_name(docs, "_gone_doc"), free_name(docs, "_gone_text")
    gone = classes(docs, percent).filter(
        (F.col("doc_id") != F.col("component_id")) | (F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    ).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (own == gone[text]), "left_anti")
