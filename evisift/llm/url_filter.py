"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's
path; the longest fitting rule wins. URLs that no rule decides are judged by two smoothed
character models of variable order, one of URLs that rules accept and one of those that they
reject: the difference of the two log-likelihoods, divided by the number of characters, is
compared with a threshold that is calibrated on the decided URLs.

Each model estimates a character after its longest history, drawn to the estimate after the
next shorter one by ``PRIOR`` characters, and so on down to none. Counts are taken over all
decided URLs that are learned from, and every history and character keeps a count of its own: the model grows with
the input. Nobody holds it whole. URLs are gathered in chunks, which bring the counts of their own histories, and get back
from the buckets those of the whole corpus for the histories they have (``chunks``). The threshold is the one with the best mean of the two
classes' hit rates on the part of the decided URLs that is not learned from (one in five).

Defined results: a null URL, or one without ``://``, has an empty host and path and meets no
rule; where the rules decide nothing at all, the models are empty and every such URL is allowed;
equal URLs get equal verdicts, repeated rows a row each, also those without a page_id. URLs may have any length: a very long one
is a chunk of its own. An empty table gives an empty result. Other columns are ignored, whatever their names.
Histories are told apart by 64-bit hashes (see ``common``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.chunks import Arrays, ask_all, corpus_chars, ids_of, with_nulls
from evisift.llm.common import lower_ascii, mixed
from evisift.session import written

#: Longest history of the character models.
ORDER = 5
#: Characters of URLs in one chunk: each makes two keys for every order.
URL_CHARS = 250_000
#: Weight of the shorter history's estimate, in characters.
PRIOR = 4.0
#: One in so many decided URLs (by their hash) calibrates the threshold.
HELD = 5
BINS = 4001
RANGE = 10.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, ASCII lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(found)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def fits(rule: UrlRule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def with_rules(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, url, host, path, rule, decided`` of every row; the last two null where no rule fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule, decided = (F.lit(None).cast("string") for _ in range(2))
    for r in reversed(ordered):
        rule = F.when(fits(r), F.lit(r.name)).otherwise(rule)
        decided = F.when(fits(r), F.lit(r.verdict)).otherwise(decided)
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.select("*", rule.alias("rule"), decided.alias("decided"))


SCORED = "page_id long, host string, path string, rule string, decided string, held boolean, ratio double"
SCORED_ARROW = pa.schema([
    ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("decided", pa.string()),
    ("held", pa.bool_()), ("ratio", pa.float64()),
])


def pack(part: pa.Table) -> Arrays:
    """Code points of all URLs, host and path between marks for start and end, and what is known of each."""
    host, path, rule, decided = (part.column(n).to_pylist() for n in ("host", "path", "rule", "decided"))
    texts = [f"\x02{h}\x1f{p}\x03" for h, p in zip(host, path)]
    strings = {}
    for name, values in (("host", host), ("path", path), ("rule", rule), ("decided", decided)):
        strings[name] = np.empty(len(values), object)
        strings[name][:] = [v or "" for v in values]
    return {
        **ids_of(part), **strings, "held": part.column("held").to_numpy(), "sizes": np.array([len(t) for t in texts], np.int64),
        "codes": np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32),
    }


def keys_of(body: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """For each order and character: the key of the character with its history, and that of the history alone.

    Histories reach back to the start of their URL, and beyond it over start marks.
    """
    codes, sizes = body["codes"].astype(np.uint64), body["sizes"]
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(codes)) - starts
    history = np.zeros((ORDER + 1, len(codes)), np.uint64)
    for k in range(1, ORDER + 1):
        before = np.where(place >= k, np.roll(codes, k), np.uint64(2))
        history[k] = history[k - 1] * np.uint64(0x100000001B3) + before + np.uint64(1)
    alone = mixed(history * np.uint64(8) + np.arange(ORDER + 1, dtype=np.uint64)[:, None], 601)
    return mixed(alone + codes[None, :] * np.uint64(0x9E3779B97F4A7C15), 602), alone


def distinct_keys(body: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a chunk, and which of them each key is (characters with histories first)."""
    return np.unique(np.concatenate([x.ravel() for x in keys_of(body)]), return_inverse=True)


def ask(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
    """Each distinct key with how often the chunk's accepted and rejected URLs have it."""
    keys, which = distinct_keys(body)
    times = 2 * (ORDER + 1)
    counts = {}
    for verdict in ("allow", "block"):
        learned = np.repeat((body["decided"] == verdict) & ~body["held"], body["sizes"])
        counts[verdict] = np.bincount(which, weights=np.tile(learned, times), minlength=len(keys)).astype(np.int64)
    return [(keys, {"key": keys, **counts})]


def answer(asked: list[Arrays]) -> list[Arrays]:
    """For each key, its counts over all chunks."""
    every, which = np.unique(np.concatenate([x["0.key"] for x in asked]), return_inverse=True)
    cuts = np.cumsum([len(x["0.key"]) for x in asked])[:-1]
    parts = {}
    for verdict in ("allow", "block"):
        total = np.bincount(which, weights=np.concatenate([x[f"0.{verdict}"] for x in asked]), minlength=len(every))
        parts[f"0.{verdict}"] = np.split(total.astype(np.int64)[which], cuts)
    return [{name: x[i] for name, x in parts.items()} for i in range(len(asked))]


def log_likelihoods(together: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Natural log probability of each character: each order's estimate is drawn to that of the order below."""
    p = np.full(together.shape[1], 1 / 256)
    for t, a in zip(together, alone):
        p = (t + PRIOR * p) / (a + PRIOR)
    return np.log(p)


def finish(body: Arrays, reply: Callable[[str], np.ndarray]) -> pa.RecordBatch:
    _, which = distinct_keys(body)
    shape = (2, ORDER + 1, len(body["codes"]))
    sums = []
    for verdict in ("allow", "block"):
        together, alone = reply(f"0.{verdict}")[which].reshape(shape)
        sums.append(np.add.reduceat(log_likelihoods(together, alone), np.cumsum(body["sizes"]) - body["sizes"]))
    named = [pa.array([x or None for x in body[n].tolist()], pa.string()) for n in ("rule", "decided")]
    return pa.RecordBatch.from_arrays([
        with_nulls(body), *(pa.array(body[n].tolist(), pa.string()) for n in ("host", "path")), *named,
        pa.array(body["held"]), pa.array((sums[0] - sums[1]) / body["sizes"]),
    ], schema=SCORED_ARROW)


def scored(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, decided, held, ratio``: log-likelihood as accepted minus that as rejected, per character.

    ``held`` URLs are not learned from.
    """
    urls = with_rules(pages, rules).select(
        F.col("page_id").alias("doc_id"), F.concat("host", "path").alias("text"), "host", "path", "rule", "decided",
        (F.pmod(F.xxhash64("host", "path"), F.lit(HELD)) == 0).alias("held"),
    )
    # a URL's characters make many more keys than a text's, so buckets are for fewer of them
    size = corpus_chars(urls) * 2 * (ORDER + 1)
    return ask_all(urls, pack, ask, answer, finish, SCORED, size, ["host", "path", "rule", "decided", "held"], URL_CHARS)


def calibrated(scored: DataFrame) -> float:
    """The ratio from which URLs are allowed: best mean of the two hit rates over ``scored(decided, ratio)``."""
    step = 2 * RANGE / (BINS - 1)
    bin_of = F.least(F.greatest(F.round((F.col("ratio") + RANGE) / step).cast("int"), F.lit(0)), F.lit(BINS - 1))
    found = scored.groupBy("decided", bin_of.alias("bin")).count().collect()  # at most two times BINS rows
    allow, block = np.zeros(BINS), np.zeros(BINS)
    for row in found:
        (allow if row["decided"] == "allow" else block)[row["bin"]] += row["count"]
    if not allow.sum() or not block.sum():
        return 0.0
    rate = np.cumsum(allow[::-1])[::-1] / allow.sum() + (np.cumsum(block) - block) / block.sum()
    best = np.flatnonzero(rate >= rate.max() - 1e-12)
    return float(best.mean() * step - RANGE - step / 2)  # in the middle of the best stretch


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio`` of every row of ``pages(page_id, url)``."""
    found = written(scored(pages, rules), "urls")
    threshold = calibrated(found.filter("decided IS NOT NULL AND held").select("decided", "ratio"))
    own = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "ratio")


def held_out_rates(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> tuple[float, float]:
    """Which shares of accepted and of rejected URLs the models tell, on half of those not learned from.

    The other half, by another hash, calibrates the threshold.
    """
    found = written(scored(pages, rules).filter("decided IS NOT NULL AND held"), "urls")
    half = F.pmod(F.xxhash64("path", "host", F.lit(1)), F.lit(2)) == 0
    threshold = calibrated(found.filter(half))
    rates = found.filter(~half).groupBy("decided").agg(F.avg((F.col("ratio") >= threshold).cast("double")).alias("allowed")).collect()
    allowed = {r["decided"]: r["allowed"] for r in rates}
    return allowed.get("allow", float("nan")), 1 - allowed.get("block", float("nan"))
