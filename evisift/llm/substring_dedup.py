"""Near-duplicate passages across documents, by compact windows over min-hashes.

The tokens of a document are its 5-word shingles. Under a hash function, all passages whose
smallest token is the one at place c form one *compact window* (l, c, r): those that start in
[l, c] and end in [c, r]. The compact windows are the nodes of the Cartesian tree over the
hashes; only nodes that span a run of ``sure_run`` tokens are needed, and the parent of such
a node is one too, so the tree is built over these few places (about 2 in 21) alone.

A stretch of ``passage_words`` words is a near duplicate of another one if at least ``least_common`` of its 46 shingles
are equal in place, which is a similarity of 0.75 or more. One differing word inside it costs five shingles, so at most one gap
fits, and 20 of the equal shingles stand in a row (``sure_run``). The smallest token of that row is chosen in both documents:
no near duplicate is missed for want of a common token, and one hash function is enough.

1. Every document asks for each of its windows which
   document is the first (smallest doc_id) with the same signature (``chunks``). A signature is
   the smallest token together with the 10 tokens before it, or with the 10 behind:
   a row of 20 has one of them inside. Groups of any size cost one entry
   per window: a member meets the first document of its group, and the first one that has the same tokens around the
   window's smallest (its *context*: all stretches that hold the token), or else the one before it.
2. Windows of one document that meet the same other document at the same shift are joined to one interval.
3. Verification: in the interval, every stretch of ``passage_words`` words is compared with the
   first document's at that shift. Passages are the
   unions of the stretches that are near duplicates, from their first to their last common shingle.
4. Where a group has three or more different contexts, two of its members may share what neither shares
   with the first. So one member for each context is compared with that of every other context, stretch by stretch. Copies
   cost nothing here, as their context is the same; groups of more than ``BLOCK`` contexts are dealt over tasks in pairs of blocks.

So all passages are found, in groups of any size, edited or not. Step 4 takes time by the square of the contexts
in a group (a line that documents share in different surroundings) only beyond ``BLOCK``, memory by two blocks: in a block of many, contexts meet
by hashes of 40 tokens, for each way to leave out six of 46 (six at the ends, or a gap of five or six).

Defined results: null, empty and short texts have no passages; repeats inside one document do
not count; repeated rows of a doc_id count as one document; a row with a null doc_id meets no other
and keeps a row of its own, with its words counted and no class; words are runs between ASCII white
space, ASCII lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import chunks
from evisift.llm.chunks import Arrays
from evisift.llm.common import (
    SHINGLE_WORDS, SIMILAR_PERCENT, SPACED_WORD, free_name, give_back, mixed, packed, run_hashes, salted_join, spaced_words,
    unpacked, word_hashes,
)
from evisift.llm.components import components
from evisift.session import written

PASSAGE_WORDS = 50
FUNCTIONS = 1
#: Contexts of one group that are compared in one go.
BLOCK = 20_000
#: From so many contexts on, a group is compared by what its members have in common, not pair by pair.
CROWD = 400
#: Of the hash of a range of tokens.
BASE = 0x9E3779B97F4A7C15

FOUND = (
    "doc_id long, kind int, n_words long, first_doc long, shift long, low long, high long, n_hashes int, body binary, key long, "
    "seat long"
)
FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("kind", pa.int32()), ("n_words", pa.int64()), ("first_doc", pa.int64()), ("shift", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("n_hashes", pa.int32()), ("body", pa.binary()), ("key", pa.int64()), ("seat", pa.int64()),
])
#: Kinds of rows above: every document; one that others may meet; an interval that meets an earlier document; a context that other
#: contexts of its group are compared with; a context that a later document has too, at a further place of the first one.
DOCUMENT, FIRST, MEMBER, CONTEXT, AGAIN = 0, 1, 2, 3, 4

#: Either side is null where a row tells only the other one's words, and both where it tells only that two documents share some.
PASSAGES = "doc_id long, first_doc long, start long, end long, first_start long, first_end long"
PASSAGES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "first_doc", "start", "end", "first_start", "first_end")])


def least_common(tokens: int, percent: int = SIMILAR_PERCENT) -> int:
    """Common ones of so many tokens on either side that make the similarity."""
    return -(-2 * percent * tokens // (100 + percent))


def sure_run(width: int, least: int) -> int:
    """Tokens in a row that are equal wherever ``least`` of ``width`` tokens are: a differing word inside costs ``SHINGLE_WORDS``."""
    return -(-least // ((width - least) // SHINGLE_WORDS + 1))


def sliding(extreme: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out, span = extreme(out[: len(out) - span], out[span:]), 2 * span
    rest = width - span
    return extreme(out[: len(out) - rest], out[rest:]) if rest else out


class Tokens:
    """The shingle sequences of a chunk's documents, one after the other; ``width`` tokens in a row have a window."""

    def __init__(self, body: Arrays, width: int):
        counts = np.maximum(body["counts"].astype(np.int64) - SHINGLE_WORDS + 1, 0)
        runs = run_hashes(body["hashes"][body["codes"]], SHINGLE_WORDS)
        ends = np.cumsum(body["counts"])
        owner = np.repeat(np.arange(len(ends)), body["counts"])[: len(runs)]
        fits = np.arange(len(runs)) + SHINGLE_WORDS <= ends[owner] if len(runs) else np.empty(0, bool)
        if "null_ids" in body:
            counts[body["null_ids"]] = 0
            fits &= ~body["null_ids"][owner]
        self.values, self.owner, self.counts = runs[fits], owner[fits], counts
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.width = width

    def hashed(self, function: int) -> np.ndarray:
        return mixed(self.values, 301 + function)

    def places(self, function: int) -> np.ndarray:
        """The places whose hash is the smallest of some stretch of ``width`` tokens of one document."""
        values, width = self.hashed(function), self.width
        if len(values) < width:
            return np.empty(0, np.int64)
        least = sliding(np.minimum, values, width)
        at = np.arange(len(least))
        least[at + width > self.ends[self.owner[: len(least)]]] = 0  # stretches across documents
        none = np.zeros(width - 1, np.uint64)
        return np.flatnonzero(sliding(np.maximum, np.concatenate([none, least, none]), width) == values)

    def thinned(self, places: np.ndarray, function: int) -> np.ndarray:
        """The places without most of those inside a dense run of one value (the same word again and again).

        Of such a run the first and last place stay, and between them one in every half stretch, so
        every stretch that has a place of the run keeps one.
        """
        near = self.width // 2
        values, owner = self.hashed(function)[places], self.owner[places]
        joined = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(places) < near)
        inner = np.flatnonzero(joined[:-1] & joined[1:]) + 1
        drop, last = [], -1
        for k in inner.tolist():
            if last < 0 or not joined[k - 1] or k - 1 not in (previous, last):
                last = k - 1
            previous = k
            if places[k] - places[last] < near:
                drop.append(k)
            else:
                last = k
        keep = np.ones(len(places), bool)
        keep[drop] = False
        return places[keep]

    def seats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash function and signature of every window; each place has one or two signatures."""
        places, functions, keys = [], [], []
        beside = self.width // 2
        for f in range(FUNCTIONS):
            place = self.thinned(self.places(f), f)
            for low, high in ((place - beside, place + 1), (place, place + beside + 1)):
                inside = (low >= self.starts[self.owner[place]]) & (high <= self.ends[self.owner[place]])
                places.append(place[inside])
                functions.append(np.full(int(inside.sum()), f))
                keys.append(mixed(self.ranges(low[inside], high[inside]), 501 + f))
        return np.concatenate(places), np.concatenate(functions), np.concatenate(keys)

    def ranges(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of the tokens from ``low`` to before ``high``."""
        powers, inverse = (np.multiply.accumulate(np.full(len(self.values) + 1, x, np.uint64)) for x in (BASE, pow(BASE, -1, 2**64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values * powers[:-1], dtype=np.uint64)])
        return mixed((sums[high] - sums[low]) * inverse[low], 401)

    def around(self, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) token of the context: ``reach`` tokens on either side, as far as the document goes."""
        owner = self.owner[places]
        return np.maximum(places - reach, self.starts[owner]), np.minimum(places + reach + 1, self.ends[owner])

    def contexts(self, places: np.ndarray, reach: int) -> np.ndarray:
        """A hash of each place's context, and of where the place stands in it."""
        low, high = self.around(places, reach)
        where = (places - low) * (2 * reach + 1) + (high - places)
        return mixed(self.ranges(low, high) + mixed(where.astype(np.uint64), 402), 403)

    def windows(self, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compact windows: place, first and last token, from the Cartesian tree over the places."""
        places = self.places(function)
        values, owner = self.hashed(function)[places].tolist(), self.owner[places]
        lows, highs = self.starts[owner].tolist(), (self.ends[owner] - 1).tolist()
        stack: list[int] = []
        for k, (place, value, doc) in enumerate(zip(places.tolist(), values, owner.tolist())):
            if stack and owner[stack[-1]] != doc:
                stack = []
            while stack and values[stack[-1]] > value:
                highs[stack.pop()] = place - 1
            if stack:
                lows[k] = int(places[stack[-1]]) + 1
            stack.append(k)
        return places, np.array(lows, np.int64), np.array(highs, np.int64)


def pack(part: pa.Table) -> Arrays:
    counts, codes, words = spaced_words(part.column("text"))
    return {**chunks.ids_of(part), "counts": counts, "codes": codes.astype(np.int32), "hashes": word_hashes(words)}


def earlier_with_key(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, contexts: np.ndarray) -> Arrays:
    """For each entry: does its key occur in several documents; where first, and where with the same context, or else in the document before.

    In the first document itself all are its own place. ``wanted``: a later document has the key. ``compare``: the entry stands
    for its context, and the first of the key doesn't tell all about it: there are three contexts or more, or a document has the key twice.
    ``again``: a further place of the first document with this context, which others have too.
    """
    names = ("several", "wanted", "compare", "again")
    if not len(keys):
        return {n: np.empty(0, bool) for n in names} | {n: np.empty(0, x.dtype) for n, x in (("first", docs), ("at", places), ("before", docs), ("before_at", places))}
    order = np.lexsort((places, docs, keys))
    keys, docs, places, contexts = keys[order], docs[order], places[order], contexts[order]
    spot = np.arange(len(keys))
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    new_doc = new_key | np.concatenate([[True], docs[1:] != docs[:-1]])
    group, groups = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
    key_start = groups[group]
    doc_start = np.maximum.accumulate(np.where(new_doc, spot, 0))
    before = np.where(doc_start > key_start, doc_start - 1, key_start)
    last_doc = docs[np.append(groups[1:], len(keys)) - 1]
    several = (last_doc != docs[groups])[group]
    wanted = docs != last_doc[group]

    # entries of a context one after the other; groups stay where they are
    by_context = np.lexsort((contexts, group))
    new_context = new_key | np.concatenate([[True], np.diff(contexts[by_context]) != 0])
    starts = np.flatnonzero(new_context)
    context = np.cumsum(new_context) - 1
    stands = by_context[starts[context]]
    other = docs[by_context] != docs[stands]
    second = other & ~np.concatenate([[False], other[:-1]])
    twice = (np.add.reduceat(new_doc.astype(np.int64), groups) < np.diff(np.append(groups, len(keys))))[group]
    many = (np.add.reduceat(new_context.astype(np.int64), groups) > 2)[group]
    of_entry = np.empty((3, len(keys)), np.int64)
    of_entry[:, by_context] = [
        stands, (many | twice) & (new_context | (twice & second)), np.logical_or.reduceat(other, starts)[context] & ~other & ~new_context,
    ]
    stands, compare, again = of_entry[0], of_entry[1] > 0, of_entry[2] > 0
    before = np.where(docs[stands] != docs, stands, before)
    back = np.empty(len(order), np.int64)
    back[order] = spot
    found = {
        "several": several, "wanted": wanted, "compare": compare, "again": again, "first": docs[key_start], "at": places[key_start],
        "before": docs[before], "before_at": places[before],
    }
    return {name: np.where(several, x, 0).astype(x.dtype)[back] for name, x in found.items()}


def shared_windows(docs: DataFrame, passage_words: int = PASSAGE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Intervals that share a signature with an earlier document, and the tokens to verify them by."""
    reach = passage_words - SHINGLE_WORDS
    width = sure_run(reach + 1, least_common(reach + 1, percent))
    chars = chunks.corpus_chars(docs)

    def ask(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
        tokens = Tokens(body, width)
        places, _, keys = tokens.seats()
        owner = tokens.owner[places]
        asked = {
            "key": keys, "doc": body["ids"][owner], "place": (places - tokens.starts[owner]).astype(np.int32),
            "context": tokens.contexts(places, reach),
        }
        return [(keys, asked)]

    def answer(asked: list[Arrays]) -> list[Arrays]:
        found = earlier_with_key(*(np.concatenate([x[f"0.{n}"] for x in asked]) for n in ("key", "doc", "place", "context")))
        cuts = np.cumsum([len(x["0.key"]) for x in asked])[:-1]
        split = {f"0.{name}": np.split(x, cuts) for name, x in found.items()}
        return [{name: parts[k] for name, parts in split.items()} for k in range(len(asked))]

    def finish(body: Arrays, reply) -> pa.RecordBatch:
        tokens = Tokens(body, width)
        places, functions, keys = tokens.seats()
        several, wanted, compare, again = (reply(f"0.{n}") for n in ("several", "wanted", "compare", "again"))
        wanted = np.unique(tokens.owner[places[wanted]]).tolist()
        short = tokens.values.astype(np.uint32)  # enough to compare tokens in place
        ids = body["ids"]
        out: dict[str, list] = {f.name: [] for f in FOUND_ARROW}

        def add(kind: int, doc: int, words=None, first_doc=None, shift=None, low=None, high=None, hashes=None, body=None, key=None, seat=None) -> None:
            for name, value in zip(out, (doc, kind, words, first_doc, shift, low, high, hashes, body, key, seat)):
                out[name].append(value)

        for kind, entries in ((CONTEXT, compare), (AGAIN, again)):
            owner = tokens.owner[places[entries]]
            a, b = tokens.around(places[entries], reach)
            columns = (x.tolist() for x in (ids[owner], tokens.starts[owner], a, b, places[entries], keys[entries].view(np.int64)))
            for doc, base, low, high, place, key in zip(*columns):
                context = {"body": short[low:high].tobytes(), "key": key, "seat": place - base} if kind == CONTEXT else {}
                add(kind, doc, low=low - base, high=high - base, **context)
        places, functions = (np.tile(x[several], 2) for x in (places, functions))
        first = np.concatenate([reply("0.first")[several], reply("0.before")[several]])
        at = np.concatenate([reply("0.at")[several], reply("0.before_at")[several]])
        owner = tokens.owner[places]
        for doc, words in zip(chunks.with_nulls(body).to_pylist(), body["counts"].tolist()):
            add(DOCUMENT, doc, words=words)
        for k in wanted:
            add(FIRST, int(ids[k]), body=packed(t=short[tokens.starts[k] : tokens.ends[k]]))
        member = first != ids[owner]
        places, functions, first, at, owner = (x[member] for x in (places, functions, first, at, owner))
        # a window spans all rows of tokens that have this smallest one; the stretches around such a row may go further
        low, high = tokens.around(places, reach)
        high = high - 1
        for f in range(FUNCTIONS) if len(places) else ():
            centre, left, right = tokens.windows(f)
            mine = functions == f
            found = np.searchsorted(centre, places[mine])
            low[mine], high[mine] = np.minimum(low[mine], left[found]), np.maximum(high[mine], right[found])
        start = tokens.starts[owner]
        shift = at - (places - start)
        order = np.lexsort((low, shift, first, owner))
        owner, first, shift, low, high, functions = (x[order] for x in (owner, first, shift, low, high, functions))
        if len(owner):  # intervals that meet at the same shift, whichever function they come from
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1]) | (shift[1:] != shift[:-1])
            groups = np.flatnonzero(new)
            bits = np.bitwise_or.reduceat(1 << functions, groups)
            for k, a, b, n in zip(groups.tolist(), np.minimum.reduceat(low, groups).tolist(), np.maximum.reduceat(high, groups).tolist(), bits.tolist()):
                base = int(tokens.starts[owner[k]])
                add(
                    MEMBER, int(ids[owner[k]]), first_doc=int(first[k]), shift=int(shift[k]), low=a - base, high=b - base,
                    hashes=n.bit_count(), body=packed(t=short[a : b + 1]),
                )
        return pa.RecordBatch.from_pydict(out, schema=FOUND_ARROW)

    return chunks.ask_all(docs, pack, ask, answer, finish, FOUND, chars)


def alike(same: np.ndarray, width: int, least: int) -> np.ndarray:
    """Whether each stretch of ``width`` tokens has ``least`` equal ones."""
    total = np.concatenate([[0], np.cumsum(same)])
    return total[width:] - total[:-width] >= least if len(same) >= width else np.empty(0, bool)


def common_runs(mine: np.ndarray, theirs: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """Unions of stretches of ``width`` tokens of which ``least`` are equal in place, from the first to the last equal token."""
    same = mine == theirs
    if len(same) < width:
        return []
    good = alike(same, width, least)
    cover = np.zeros(len(same) + 1, int)
    np.add.at(cover, np.flatnonzero(good), 1)
    np.add.at(cover, np.flatnonzero(good) + width, -1)
    covered = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(int)
    edges = np.diff(covered)
    runs = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        equal = np.flatnonzero(same[a:b])
        runs.append((a + int(equal[0]), a + int(equal[-1]) + 1))
    return runs


class Contexts:
    """Contexts of whole groups, sorted by group and doc_id, one a row, each with its seat in the middle column."""

    def __init__(self, rows: pa.Table, width: int):
        self.width = width
        number = lambda n: rows.column(n).to_numpy()
        self.docs, self.block, self.paired = number("doc_id"), number("block"), number("a") != number("b")
        self.origin = number("seat") - width + 1
        new = np.zeros(len(self.docs), bool)
        for n in ("key", "a", "b"):
            new[1:] |= number(n)[1:] != number(n)[:-1]
        self.group = np.cumsum(new)
        self.tokens, self.valid = np.zeros((len(new), 2 * width - 1), np.uint32), np.zeros((len(new), 2 * width - 1), bool)
        for k, (body, skip) in enumerate(zip(rows.column("body").to_pylist(), (number("low") - self.origin).tolist())):
            tokens = np.frombuffer(body, np.uint32)
            self.tokens[k, skip : skip + len(tokens)] = tokens
            self.valid[k, skip : skip + len(tokens)] = True

    def near(self, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those pairs of rows that have a near duplicate stretch around the seat, and which columns these stretches cover."""
        same = (self.tokens[a] == self.tokens[b]) & self.valid[a] & self.valid[b]
        some = same.sum(axis=1) >= least
        a, b, same = a[some], b[some], same[some]
        both, width, columns = self.valid[a] & self.valid[b], self.width, 2 * self.width - 1
        total = np.zeros((len(a), columns + 1), np.int32)
        np.cumsum(same, axis=1, out=total[:, 1:])
        good = (total[:, width:] - total[:, :-width] >= least) & both[:, :width] & both[:, width - 1 :]
        some = good.any(axis=1)
        a, b, same, good = a[some], b[some], same[some], good[some]
        at = np.arange(columns)
        following = np.minimum.accumulate(np.where(same, at, columns)[:, ::-1], axis=1)[:, ::-1]
        last = np.maximum.accumulate(np.where(same, at, -1), axis=1)
        row, start = np.nonzero(good)
        edges = np.zeros((len(a), columns + 1), np.int32)
        np.add.at(edges, (row, following[row, start]), 1)
        np.add.at(edges, (row, last[row, start + width - 1] + 1), -1)
        return a, b, np.cumsum(edges[:, :-1], axis=1) > 0

    def patterns(self, least: int, common: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """First column, gap (first and last, exclusive) and end of ``least`` tokens; no gap over a column that all have in common."""
        columns = 2 * self.width - 1
        for first in range(columns - least + 1):
            yield first, first, first, first + least
        for gap in range(SHINGLE_WORDS, self.width - least + 1):
            for first in range(columns - least - gap + 1):
                for low in range(first + 1, first + least):
                    if not common[low : low + gap].any():
                        yield first, low, low + gap, first + least + gap

    def crowd(self, rows: slice, least: int, later: np.ndarray, earlier: np.ndarray, join: Callable[[int, int], None], label: np.ndarray) -> None:
        """As pair by pair, for one group: all that have a pattern's tokens in common are near duplicates of each other."""
        width, tokens, valid = self.width, self.tokens[rows], self.valid[rows]
        docs, at = self.docs[rows], np.arange(rows.start, rows.stop)
        powers = np.multiply.accumulate(np.full(tokens.shape[1], BASE, np.uint64))
        sums = np.zeros((tokens.shape[1] + 1, len(tokens)), np.uint64)
        np.cumsum((tokens * powers).T, axis=0, out=sums[1:])
        edges = np.zeros((2, tokens.shape[1] + 1, len(tokens)), np.int32)
        common = (tokens == tokens[0]).all(axis=0) & valid.all(axis=0)
        for first, low, high, end in self.patterns(least, common):
            whole = sums[low] - sums[first] + sums[end] - sums[high]
            told: list[np.ndarray] = []
            for start in range(max(end - width, 0), min(first, width - 1) + 1):  # a stretch around it that both have
                inside = valid[:, start] & valid[:, start + width - 1]
                if any((inside <= other).all() for other in told):
                    continue
                told.append(inside)
                rows_in = np.flatnonzero(inside)
                keys = whole[rows_in]
                ordered = np.sort(keys)
                twice = ordered[1:][ordered[1:] == ordered[:-1]]
                if not len(twice):
                    continue
                some = np.isin(keys, twice)
                rows_in, keys = rows_in[some], keys[some]
                order = np.argsort(keys, kind="stable")  # documents of a key stay in their order
                rows_in, keys = rows_in[order], keys[order]
                begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
                least_doc, most_doc = docs[rows_in[begin]], docs[rows_in[np.append(begin[1:], len(keys)) - 1]]
                for side, has in ((0, docs[rows_in] > least_doc[which]), (1, docs[rows_in] < most_doc[which])):
                    edges[side, first, rows_in[has]] += 1
                    edges[side, end, rows_in[has]] -= 1
                heads, members = at[rows_in[begin[which]]], at[rows_in]
                apart = (label[heads] != label[members]) & (self.docs[heads] != self.docs[members])
                for i, j in zip(heads[apart].tolist(), members[apart].tolist()):
                    join(i, j)
        later[rows] |= (np.cumsum(edges[0, :-1], axis=0) > 0).T
        earlier[rows] |= (np.cumsum(edges[1, :-1], axis=0) > 0).T

    def passages(self, least: int) -> list[pa.RecordBatch]:
        """What each context shares with smaller and with larger documents, and pairs of documents that connect all that share."""
        later, earlier = np.zeros_like(self.valid), np.zeros_like(self.valid)
        label, links = np.arange(len(self.docs)), set()

        def join(i: int, j: int) -> None:
            if label[i] != label[j]:
                links.add((int(self.docs[j]), int(self.docs[i])))
                low, high = np.searchsorted(self.group, [self.group[i], self.group[i] + 1])
                part = label[low:high]
                part[part == label[j]] = label[i]

        begin = np.flatnonzero(np.diff(self.group, prepend=-1))
        sizes = np.diff(np.append(begin, len(self.group)))
        pair_by_pair = np.ones(len(self.group), bool)
        if self.width - least < 2 * SHINGLE_WORDS:  # one gap at most
            for a, n in zip(begin[sizes >= CROWD].tolist(), sizes[sizes >= CROWD].tolist()):
                pair_by_pair[a : a + n] = False
                self.crowd(slice(a, a + n), least, later, earlier, join, label)
        for step in range(1, len(self.docs)):
            a = np.flatnonzero((self.group[:-step] == self.group[step:]) & pair_by_pair[step:])
            if not len(a):
                break
            b = a + step
            a = a[(self.docs[a] != self.docs[b]) & ~(self.paired[a] & (self.block[a] == self.block[b]))]
            a, b, cover = self.near(a, a + step, least)
            earlier[a] |= cover
            later[b] |= cover
            for i, j in np.column_stack([a, b])[label[a] != label[b]].tolist():
                join(i, j)
        none = pa.nulls
        out = [pa.table([[x[0] for x in links], [x[1] for x in links], *[none(len(links), pa.int64())] * 4], schema=PASSAGES_ARROW)]
        for cover, is_later in ((later, True), (earlier, False)):
            padded = np.zeros((len(cover), cover.shape[1] + 2), np.int8)
            padded[:, 1:-1] = cover
            edges = np.diff(padded, axis=1)
            (row, start), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
            told = [pa.array(x, pa.int64()) for x in (self.docs[row], self.origin[row] + start, self.origin[row] + end + SHINGLE_WORDS - 1)]
            empty = none(len(row), pa.int64())
            columns = [told[0], empty, told[1], told[2], empty, empty] if is_later else [empty, told[0], empty, empty, told[1], told[2]]
            out.append(pa.table(columns, schema=PASSAGES_ARROW))
        return pa.concat_tables(out).combine_chunks().to_batches()


def whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int = 1_000) -> Iterator[pa.Table]:
    """The sorted rows of a task, some groups at a time: no group is cut."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held.append(rows)
        if sum(x.num_rows for x in held) < least_rows:
            continue
        rows = pa.concat_tables(held)
        ends = [rows.column(n).to_numpy() for n in ("key", "a", "b")]
        inner = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ends], axis=0)) + 1
        cut = int(inner[-1]) if len(inner) else 0
        if cut:
            yield rows.slice(0, cut)
        held = [rows.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def met_in_groups(found: DataFrame, passage_words: int, percent: int, block: int | None = None) -> DataFrame:
    """Passages that contexts of one group share, each compared with every other one."""
    width = passage_words - SHINGLE_WORDS + 1
    least, block = least_common(width, percent), block or BLOCK
    rows = found.filter(F.col("kind") == CONTEXT).select("key", "doc_id", "low", "seat", "body")
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    # fewer keys than blocks
    large = F.broadcast(sizes.select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(large, "key", "left").withColumns({"block": F.pmod(F.xxhash64("doc_id", "seat"), blocks).cast("int"), "_blocks": blocks})
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.withColumns({"a": F.least("block", "_other"), "b": F.greatest("block", "_other")}).drop("_blocks", "_other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches):
            yield from Contexts(part, width).passages(least)
            give_back()

    groups = paired.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "doc_id", "seat")
    return groups.mapInArrow(compare, PASSAGES)


def verified(found: DataFrame, passage_words: int = PASSAGE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Passages (ranges of words, end exclusive) of documents and where an earlier document has them."""
    width = passage_words - SHINGLE_WORDS + 1
    least = least_common(width, percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int | None, ...]] = []
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "first_doc", "shift", "low"))
            for doc, first, shift, low, mine, theirs in zip(*columns, batch.column("body"), batch.column("first_body")):
                a, b = (unpacked(x.as_py())["t"] for x in (mine, theirs))
                skip = max(0, -(low + shift))
                begin = low + skip
                a, b = a[skip:], b[begin + shift : begin + shift + len(a) - skip]
                n = min(len(a), len(b))
                for s, e in common_runs(a[:n], b[:n], width, least):
                    start, end = begin + s, begin + e + SHINGLE_WORDS - 1
                    out.append((doc, first, start, end, start + shift, end + shift))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 6, schema=PASSAGES_ARROW)

    firsts = found.filter(F.col("kind") == FIRST).select(F.col("doc_id").alias("first_doc"), F.col("body").alias("first_body"))
    firsts = written(firsts.dropDuplicates(["first_doc"]), "firsts")
    members = found.filter(F.col("kind") == MEMBER).select("doc_id", "first_doc", "shift", "low", "body")
    # a document that very many meet is met in several tasks
    pairs = salted_join(members, firsts, "first_doc", "doc_id")
    null = F.lit(None).cast("long")
    again = found.filter(F.col("kind") == AGAIN).select(
        null.alias("doc_id"), F.col("doc_id").alias("first_doc"), null.alias("start"), null.alias("end"),
        F.col("low").alias("first_start"), (F.col("high") + SHINGLE_WORDS - 1).alias("first_end"),
    )
    return pairs.mapInArrow(check, PASSAGES).union(again).union(met_in_groups(found, passage_words, percent))


def merged(ranges: DataFrame, name: str) -> DataFrame:
    """Per document the union of its ranges ``(doc_id, start, end)``, as an ordered array ``name``."""
    from pyspark.sql import Window

    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.distinct().withColumn("opens", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    unions = opened.withColumn("block", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    unions = unions.groupBy("doc_id", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return unions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))


def words_in(spans: str):
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long"))


def passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``.

    ``repeated``: its passages (ranges of words) that another document also has. ``later``: those
    of them that a document with a smaller doc_id has. ``class_id``: the smallest doc_id that can
    be reached from one document to the next over shared passages.
    ``first_docs``: earlier documents that link it to its class; others of the class may share the same passages.
    """
    found = written(shared_windows(docs, passage_words), "windows")
    met = written(verified(found, passage_words), "passages")
    later = met.filter("start IS NOT NULL").select("doc_id", "start", "end")
    earlier = met.filter("first_start IS NOT NULL").select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start"), F.col("first_end").alias("end"))
    links = met.filter("doc_id IS NOT NULL AND first_doc IS NOT NULL")
    first_docs = links.groupBy("doc_id").agg(F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    classes = components(links.select(F.col("doc_id").alias("a"), F.col("first_doc").alias("b")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    rows = (
        found.filter(F.col("kind") == DOCUMENT).select("doc_id", "n_words")
        .join(merged(later.union(earlier), "repeated"), "doc_id", "left")
        .join(merged(later, "later"), "doc_id", "left")
        .join(first_docs, "doc_id", "left")
        .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    )
    return rows.select(
        "doc_id", "n_words", words_in("repeated").alias("n_repeated"), words_in("later").alias("n_later"),
        F.coalesce("label", "doc_id").alias("class_id"),
        F.coalesce("repeated", none).alias("repeated"), F.coalesce("later", none).alias("later"),
        F.coalesce("first_docs", F.expr("cast(array() as array<bigint>)")).alias("first_docs"),
    )


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without these ranges of words (and the white space behind each)."""
    places = [m.span() for m in re.finditer(SPACED_WORD, text)]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"]][0] if span["end"] < len(places) else len(text)
    return "".join([*kept, text[at:]])


def cut(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without the passages that a document with a smaller doc_id has.

    Each passage stays in the first document that has it. Rows and columns stay; ``text``
    and, where it exists, ``n_chars`` change. A text that was a repeat from end to end goes.
    """
    found = written(shared_windows(docs, passage_words), "windows")
    doc, where = free_name(docs, "_doc"), free_name(docs, "_spans")
    later = verified(found, passage_words).filter("start IS NOT NULL").select("doc_id", "start", "end")
    spans = merged(later, where).withColumnRenamed("doc_id", doc)
    joined = docs.join(spans, docs["doc_id"] == spans[doc], "left").drop(spans[doc])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(where).to_pylist()
            texts = batch.column("text").to_pylist() if any(spans) else []
            new = {k: without_spans(texts[k], s) for k, s in enumerate(spans) if s}
            for k, text in new.items():
                texts[k] = text
            plain = batch.drop_columns([where])
            if new:
                at = plain.schema.get_field_index("text")
                plain = plain.set_column(at, plain.schema.field(at), pa.array(texts, plain.schema.field(at).type))
                if "n_chars" in plain.schema.names:
                    at = plain.schema.get_field_index("n_chars")
                    sizes = [len(new[k]) if k in new else n for k, n in enumerate(plain.column(at).to_pylist())]
                    plain = plain.set_column(at, plain.schema.field(at), pa.array(sizes, plain.schema.field(at).type))
            yield plain.filter(pa.array([k not in new or bool(new[k].strip()) for k in range(len(spans))], pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
