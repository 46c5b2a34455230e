"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element is a node. Its features are its tag, the words of its class, id and role (and
those of its ancestors), text and link density of its subtree, depth, and how it compares with
its siblings. The trees estimate whether a node belongs to the article. Decoding picks the
most probable labelling of the whole page in which nothing inside a rejected node is kept: a
node's best score as kept is its own log-odds plus the better of kept and rejected for each child;
a rejected node takes its subtree with it. So ancestor and descendant never contradict.

There are no labels for pages, so the training pages are made from the given ones: the headings
and paragraphs of a bounded, documented number of them (``TRAIN_PAGES``, chosen by a hash of the
URL) are put into page layouts of many kinds, with menus, headers, footers, sidebars, notices,
adverts, forms and reader comments around and inside the article, named as such parts
usually are. Each node's label is known from its making.

Defined results: null and empty html have no text; scripts, styles, comments and markup never
appear; of an unclosed button, select, object, svg, template or noscript what comes before the next
block element is lost, of an unclosed script, style, textarea, title or iframe the rest of the page; other unclosed and stray tags are repaired the way browsers do for paragraphs, lists and
table cells; equal pages get equal texts, repeated rows a row each; other columns are ignored, whatever their names.
Very long pages, and pages of unclosed tags, quotes or comments, take time in proportion to their length; marks of training pages mean
nothing on given ones.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm.common import chunked

TRAIN_PAGES = 150
LAYOUTS = 6
TREES, DEPTH, RATE, BINS = 50, 4, 0.25, 32

# --- parsing ---------------------------------------------------------------------------------

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button head".split())
#: Of these, what browsers read as text up to the end tag or else the end of the page; and what can't hold its like.
TO_END, NOT_NESTED = frozenset("script style textarea title iframe".split()), frozenset("button select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br input".split()
)
#: A start tag of the first kind ends open elements of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body".split())

TAGS = "html body article main section div p h1 h2 h3 ul ol li nav header footer aside form table td blockquote pre figure".split()
#: An element of RAW without its end tag ends before the next of these, start or end.
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(TAGS[1:])}|h[4-6]|dl|dt|dd|tr|th|address|details|fieldset|hr)(?=[\s/>])", re.I)
TAG_NUMBER = {t: i + 1 for i, t in enumerate(TAGS)}

#: Words that name parts of a page, by part. A longer word that starts with one counts too.
PARTS = {
    "menu": "nav menu breadcrumb breadcrumbs navigation navbar pagination pager toc tabs".split(),
    "header": "header masthead topbar banner logo branding".split(),
    "footer": "footer copyright legal colophon bottom".split(),
    "side": "sidebar side aside related recommended widget trending popular more share social tags".split(),
    "notice": "notice cookie cookies consent alert popup modal gdpr message toast".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion".split(),
    "form": "form search login signup subscribe newsletter register input".split(),
    "comments": "comment comments discussion replies reply respond disqus feedback".split(),
    "content": "article content post entry story body text main page prose".split(),
}
PART_NAMES = list(PARTS)
WORD_PART = {w: i for i, words in enumerate(PARTS.values()) for w in words}
STEMS = sorted(((w, i) for w, i in WORD_PART.items() if len(w) >= 5), key=lambda x: -len(x[0]))

FEATURES = (
    ["tag", "depth", "chars", "words", "link_share", "tags_per_char", "children", "siblings", "place", "same_tag", "sibling_chars", "page_share"]
    + [f"own_{p}" for p in PART_NAMES] + [f"above_{p}" for p in PART_NAMES]
    + ["in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_article"]
)
INSIDE = ["nav", "header", "footer", "aside", "form", "article"]


def part_of(word: str) -> int:
    found = WORD_PART.get(word, -1)
    return found if found >= 0 else next((i for stem, i in STEMS if word.startswith(stem)), -1)


class OpenElements:
    """The open elements of a page, with counts, so that no question about them walks through them.

    ``since_scope`` counts the elements opened since the innermost of SCOPE, ``since_block`` the inline ones since the innermost
    block.
    """

    __slots__ = ("stack", "opened", "scopes", "blocks", "links")

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # inline elements carry their block's number
        self.opened: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]
        self.blocks: list[Counter] = [Counter()]
        self.links = 0
        self.push("html", 0)

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.opened[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPE:
            self.scopes.append(Counter())
        if tag in INLINE:
            self.blocks[-1][tag] += 1
        else:
            self.blocks.append(Counter())
        self.links += tag == "a"

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.opened[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        if tag in INLINE:
            self.blocks[-1][tag] -= 1
        else:
            self.blocks.pop()
        self.links -= tag == "a"
        return tag

    def node(self) -> int:
        return self.stack[-1][1]

    def end(self, tag: str) -> bool:
        """Close the innermost ``tag`` and what is open inside it; a stray end closes nothing."""
        if not self.opened[tag] or (tag in INLINE and not self.blocks[-1][tag]):
            return False
        while self.pop() != tag:
            pass
        if not self.stack:
            self.push("html", 0)
        return True

    def end_before(self, tag: str) -> None:
        """Close what the start of a block ends: open paragraphs, and elements of its like, up to the innermost of SCOPE."""
        ended = ENDS.get(tag, ())
        since = self.scopes[-1]
        while since["p"] or any(since[t] for t in ended):
            self.pop()


class Page:
    """Block elements of a page in document order, and its texts with the element each belongs to.

    The time is in proportion to the page, whatever it holds. ``made`` pages are those for training, whose elements
    say what they are; a given page's attributes are never read for that.
    """

    __slots__ = ("tags", "parents", "parts", "label", "pieces", "links", "inline", "made")

    def __init__(self, html: str | None, made: bool = False):
        self.tags, self.parents, self.parts, self.label = ["html"], [-1], [0], [""]
        self.pieces: list[tuple[int, str]] = []
        self.links, self.inline = [0], [0]
        self.made = made
        self.parse(html or "")

    def parse(self, html: str) -> None:
        opened = OpenElements()
        node, at = 0, 0
        size = html.rfind(">") + 1  # no tag ends behind it, so every tag that begins before it has an end
        pieces = self.pieces
        unclosed: set[str] = set()  # no end tag is left on the page
        for m in iter(lambda: TOKEN.search(html, at, size), None):
            if m.start() > at:
                self.text(node, html[at : m.start()], opened.links)
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if m.group().startswith("<!--") and not m.group().endswith("-->"):
                    return  # a comment to the end of the page
                continue
            tag = tag.lower()
            if m.group(1):
                if tag not in ("html", "body") and opened.end(tag):
                    if tag not in INLINE:
                        pieces.append((-1, ""))
                    node = opened.node()
                continue
            if tag in RAW:
                kind = f"</?{tag}" if tag in NOT_NESTED else f"</{tag}"
                found = None if tag in unclosed else re.compile(rf"{kind}(?=[\s/>])", re.I).search(html, at)
                if not found:
                    unclosed.add(tag)
                end = found.start() if found and html[found.start() + 1] == "/" else -1
                if m.group(3).endswith("/") and tag == "svg":
                    continue
                close = html.find(">", end) if end >= 0 else -1
                if tag == "head" and end < 0:
                    continue
                if end < 0 and tag not in TO_END:
                    block = BLOCK_TAG.search(html, at)
                    at = block.start() if block else len(html)
                    continue
                at = close + 1 if close >= 0 else len(html)
                continue
            if tag == "html":
                continue
            if tag in INLINE:
                self.inline[node] += 1
                if tag == "br":
                    pieces.append((node, " "))
                elif tag not in VOID:  # a slash at the end of a start tag closes nothing, as in browsers
                    opened.push(tag, node)
                continue
            opened.end_before(tag)
            node = opened.node()
            pieces.append((-1, ""))
            number = len(self.tags)
            parts, label = 0, ""
            if m.group(3):
                for a, b, c in NAMED.findall(m.group(3)):
                    for word in PART.findall(a or b or c):
                        found = part_of(word.lower())
                        if found >= 0:
                            parts |= 1 << found
                if self.made and "data-made=" in m.group(3):
                    label = m.group(3).split("data-made=")[1][0]
            self.tags.append(tag)
            self.parents.append(node)
            self.parts.append(parts)
            self.label.append(label)
            self.links.append(0)
            self.inline.append(0)
            if tag not in VOID:
                opened.push(tag, number)
                node = number
        rest = html[at:].split("<!--", 1)[0]
        if rest:
            self.text(node, rest, opened.links)

    def text(self, node: int, raw: str, link: int) -> None:
        if link > 0:
            self.links[node] += len(raw)
        self.pieces.append((node, raw))

    def features(self) -> np.ndarray:
        n = len(self.tags)
        chars, words = np.zeros(n), np.zeros(n)
        for node, raw in self.pieces:
            if node >= 0:
                chars[node] += len(raw)
                words[node] += raw.count(" ")
        links, inline, count = np.array(self.links, float), np.array(self.inline, float), np.ones(n)
        depth, children, own_chars = np.zeros(n), np.zeros(n), chars.copy()
        parents = self.parents
        above = [0] * n
        inside = [0] * n
        place = np.zeros(n)
        for i in range(1, n):
            p = parents[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            above[i] = above[p] | self.parts[p]
            t = self.tags[i]
            inside[i] = inside[p] | (1 << INSIDE.index(t) if t in INSIDE else 0)
        for i in range(n - 1, 0, -1):
            p = parents[i]
            chars[p] += chars[i]
            words[p] += words[i]
            links[p] += links[i]
            inline[p] += inline[i]
            count[p] += count[i]
        up = np.maximum(np.array(parents), 0)
        tag = np.array([TAG_NUMBER.get(t, 0) for t in self.tags], float)
        same = np.zeros(n)
        kinds: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            kinds[parents[i], self.tags[i]] = kinds.get((parents[i], self.tags[i]), 0) + 1
        for i in range(1, n):
            same[i] = kinds[parents[i], self.tags[i]]
        siblings = children[up]
        columns = [
            tag, depth, np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), np.log1p((inline + count) / np.maximum(chars, 1) * 100),
            children, siblings, place / np.maximum(siblings, 1), same, np.log1p(np.maximum(chars[up] - chars - own_chars[up], 0) / np.maximum(siblings - 1, 1)),
            chars / max(chars[0], 1),
        ]
        own_bits, above_bits, inside_bits = np.array(self.parts), np.array(above), np.array(inside)
        columns += [own_bits >> k & 1 for k in range(len(PART_NAMES))] + [above_bits >> k & 1 for k in range(len(PART_NAMES))]
        columns += [inside_bits >> k & 1 for k in range(len(INSIDE))]
        return np.column_stack(columns).astype(np.float32)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The most probable labelling in which whatever is inside a rejected node is rejected."""
        n = len(self.tags)
        kept = -np.logaddexp(0, -margin)
        lost = -np.logaddexp(0, margin)
        kept[0] = 0.0
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            kept[p] += max(kept[i], lost[i])
            lost[p] += lost[i]
        keep = np.ones(n, bool)
        for i in range(1, n):
            keep[i] = keep[self.parents[i]] and kept[i] > lost[i]
        return keep

    def main_text(self, keep: np.ndarray) -> str:
        """Texts of kept nodes: one line for each block, references decoded, white space as single blanks."""
        blocks, open_block = [], []
        for node, raw in self.pieces:
            if node < 0:
                if open_block:
                    blocks.append("".join(open_block))
                    open_block = []
            elif keep[node]:
                open_block.append(raw)
        if open_block:
            blocks.append("".join(open_block))
        lines = (" ".join(unescape(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


# --- training pages --------------------------------------------------------------------------


def training_pages(texts: list[list[str]], seed: int = 7) -> list[str]:
    """Pages of many layouts, made from lists of lines; ``data-made`` is 1 on article nodes and 0 on others."""
    draw = random.Random(seed)
    lines = [x for t in texts for x in t if x]
    if not lines:
        lines = ["Some words of text, and then a few more of them.", "A second line."]

    def some(low: int, high: int, words: int = 0) -> list[str]:
        found = [draw.choice(lines) for _ in range(draw.randint(low, high))]
        return [" ".join(x.split()[:words]) for x in found] if words else found

    def named(*names: str) -> str:
        kind = draw.choice(["class", "class", "id"])
        word = draw.choice(names)
        return f' {kind}="{draw.choice(["", "", "site-", "page-", "block "])}{word}{draw.choice(["", "", "-box", " wide", "-1"])}"'

    def box(tag: str, made: int, inner: str, attributes: str = "") -> str:
        return f"<{tag}{attributes} data-made={made}>{inner}</{tag}>"

    def linked(made: int = 0) -> str:
        items = "".join(box("li", made, f'<a href="#">{x}</a>') for x in some(2, 8, 2))
        return box(draw.choice(["ul", "ul", "ol"]), made, items)

    def anchors() -> str:
        return draw.choice([" ", " | ", ""]).join(f'<a href="#">{x}</a>' for x in some(1, 6, 2))

    def paragraphs(made: int, low: int, high: int, words: int = 0) -> str:
        return "".join(box("p", made, x) for x in some(low, high, words))

    def junk(inside: bool) -> str:
        prose = lambda: draw.choice([paragraphs(0, 1, 3), draw.choice(lines), paragraphs(0, 1, 2, 8)])
        name = lambda part: named(*PARTS[part])
        kinds = [
            lambda: box("div", 0, prose(), name("advert")), lambda: box(draw.choice(["div", "section"]), 0, prose(), name("notice")),
            lambda: box("aside", 0, prose() + linked(), draw.choice(["", name("side")])), lambda: box("div", 0, linked() + prose(), name("side")),
            lambda: box("form", 0, draw.choice(["", prose()]) + f"<label>{' '.join(some(1, 1, 2))}</label><input>", draw.choice(["", name("form")])),
            lambda: box("div", 0, prose(), name("form")),
            lambda: box(draw.choice(["section", "div", "ol"]), 0, box("h3", 0, some(1, 1, 2)[0]) + "".join(box(draw.choice(["div", "li", "article"]), 0, paragraphs(0, 1, 2), draw.choice(["", named("comment")])) for _ in range(draw.randint(1, 5))), name("comments")),
            lambda: box("nav", 0, draw.choice([linked, anchors])(), draw.choice(["", name("menu")])),
            lambda: box("div", 0, draw.choice([linked, anchors])(), name("menu")),
        ]
        if not inside:
            kinds += [
                lambda: box("header", 0, draw.choice([prose(), linked(), anchors(), ""]) + draw.choice([box("h1", 0, some(1, 1, 3)[0]), draw.choice(lines)]), draw.choice(["", name("header")])),
                lambda: box("div", 0, box("h1", 0, some(1, 1, 3)[0]) + prose(), name("header")),
                lambda: box("footer", 0, prose() + draw.choice(["", linked(), anchors()]), draw.choice(["", name("footer")])), lambda: box("div", 0, prose(), name("footer")),
            ]
        return draw.choice(kinds)()

    def article() -> str:
        inner = [box("h1", 1, some(1, 1, 12)[0])] if draw.random() < 0.8 else []
        for _ in range(draw.choice([1, 2, 4, 8, 16])):
            kind = draw.random()
            if kind < 0.7:
                inner.append(paragraphs(1, 1, 2))
            elif kind < 0.76:
                inner.append(box(draw.choice(["h2", "h3"]), 1, some(1, 1, 6)[0]))
            elif kind < 0.82:
                inner.append(box(draw.choice(["ul", "ol"]), 1, "".join(box("li", 1, x) for x in some(2, 5, 20))))
            elif kind < 0.86:
                inner.append(box("blockquote", 1, paragraphs(1, 1, 1)))
            elif kind < 0.89:
                inner.append(box("table", 1, "".join(box("tr", 1, "".join(box("td", 1, x) for x in some(2, 3, 3))) for _ in range(3))))
            elif kind < 0.91:
                inner.append(box("pre", 1, draw.choice(lines)))
            elif kind < 0.93:
                inner.append(box("div", 1, paragraphs(1, 1, 3)))
            else:
                inner.append(junk(inside=True))
        if draw.random() < 0.3:
            inner.append(junk(inside=True))
        wrapper = draw.choice(["article", "article", "main", "div", "section"])
        attributes = named(*PARTS["content"]) if wrapper == "div" or draw.random() < 0.3 else ""
        whole = box(wrapper, 1, "".join(inner), attributes)
        for _ in range(draw.choice([0, 0, 1, 2])):
            whole = box(draw.choice(["div", "main", "section"]), 1, whole + (junk(inside=False) if draw.random() < 0.4 else ""), draw.choice(["", named("wrapper", "container", "content", "page")]))
        return whole

    pages = []
    for _ in range(LAYOUTS * max(len(texts), 25)):
        before = "".join(junk(inside=False) for _ in range(draw.randint(0, 4)))
        after = "".join(junk(inside=False) for _ in range(draw.randint(0, 4)))
        pages.append(f"<html><head><title>x</title></head><body data-made=1>{before}{article()}{after}</body></html>")
    return pages


# --- gradient-boosted trees ------------------------------------------------------------------


class Boosted:
    """Gradient boosting for a logistic loss: binned features, trees of fixed depth kept as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self.grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]

    def grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        inner = 2**DEPTH - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(gradient), int)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                best, f, b = self.split(binned[rows], gradient[rows], hessian[rows])
                right = np.zeros(len(rows), bool)
                if best > 1e-6:
                    feature[node], cut[node] = f, self.cuts[f][b]
                    right = binned[rows, f] > b
                at[rows] = 2 * node + 1 + right
        leaf = at - inner
        g, h = (np.bincount(leaf, weights=v, minlength=2**DEPTH) for v in (gradient, hessian))
        return (feature, cut, RATE * g / (h + 1.0)), leaf

    def split(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int, int]:
        best = (0.0, 0, 0)
        total_g, total_h = gradient.sum(), hessian.sum()
        if len(gradient) < 20:
            return best
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            g = np.cumsum(np.bincount(binned[:, f], weights=gradient, minlength=len(cuts) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, f], weights=hessian, minlength=len(cuts) + 1))[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (float(gain[b]), f, b)
        return best

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def lines_of_some(pages: DataFrame, train_pages: int) -> list[list[str]]:
    """Lines of at most about ``train_pages`` pages, taken by a hash: no more than 200 of 2,000 characters of each reach the driver."""
    share = min(1.0, train_pages / max(pages.count(), 1))
    bound = min(2**63 - 1, int((share - 0.5) * 2**64))  # of 64-bit hashes, so that no share rounds to none
    chosen = pages.filter(F.xxhash64("url", "page_id") <= bound).select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, text="html", chars=1_000_000):
            lines = []
            for html in part.column("html").to_pylist():
                page = Page(html)
                lines.append([x for x in page.main_text(np.ones(len(page.tags), bool)).split("\n") if len(x) < 2_000][:200])
            yield pa.RecordBatch.from_pydict({"lines": lines}, schema=pa.schema([("lines", pa.list_(pa.string()))]))

    return sorted(r["lines"] for r in chosen.mapInArrow(run, "lines array<string>").collect())


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Boosted:
    """Trees fitted on layouts made from the lines of at most about ``train_pages`` pages."""
    made = [Page(html, made=True) for html in training_pages(lines_of_some(pages, train_pages))]
    x = np.concatenate([p.features() for p in made])
    label = np.concatenate([np.array(p.label) for p in made])
    return Boosted(x[label != ""], (label[label != ""] == "1").astype(float))


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    model = train(pages, train_pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunked(batches, text="html", chars=1_000_000):
            parsed = [Page(html) for html in part.column("html").to_pylist()]
            margin = model.margin(np.concatenate([p.features() for p in parsed]))
            ends = np.cumsum([len(p.tags) for p in parsed])
            texts = [p.main_text(p.decode(margin[e - len(p.tags) : e])) for p, e in zip(parsed, ends.tolist())]
            yield pa.RecordBatch.from_pydict({
                "page_id": part.column("page_id").combine_chunks(), "url": part.column("url").combine_chunks(),
                "text": texts, "n_chars": [len(t) for t in texts],
            }, schema=schema)

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
