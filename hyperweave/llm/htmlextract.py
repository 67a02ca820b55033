"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks, each with its place among the open elements. A logistic classifier gives each
block the log-odds of being content, from its text (length, links, punctuation), its element and the names of the
elements around it. They are its capacity: to the source if content is likelier, else to the sink. Blocks that
follow each other are joined by edges whose capacity falls with their distance in the tree of elements, blocks that
follow each other in one container with others between them by weaker ones. Maximum flow gives the minimum cut:
what stays on the source's side is the text. So a short line among paragraphs goes with them, and a link list's one
long entry with its list, whatever the classifier alone would say.

The classifier is fitted on a bounded sample of pages. Its labels are the elements that say what they hold (article
and main, without nav, aside, form and the like); as those labels can be wrong, they count as NOISE less than
certain, which bounds the log-odds. Each block is also learned without the names around it, so pages that name
nothing are told by their text. Within an element whose name says boilerplate, only that name counts: comments and
adverts are written like articles.

Defined results: null and empty pages, and pages without content, give the empty string. Character references
are decoded, white space within a block (line breaks too) becomes one blank, blocks are joined by one line end. A
quote that never ends is an ordinary character of its tag, a tag that never ends is text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stable_order

#: The sample of pages that the classifier is fitted on, and characters of the longest.
TRAIN_PAGES = 400
MAX_CHARS = 200_000
STEPS = 300
#: Capacity between blocks that follow each other as siblings, its fall with each further step in the tree, and the
#: capacity between blocks that follow each other in one container with others between them.
BESIDE, FALL, FOLLOWING = 1.5, 0.6, 0.5
#: How often a label may be wrong.
NOISE = 0.02

# Fixed values of HTML: elements by kind.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag of the key closes the innermost open blocks while they are among the values.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination",
    "popup", "promo", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "alert", "responses", "warning",
}
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story", "articlebody"}

TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Words that name a place or a shape, not a purpose.
PLACES = {
    "area", "bar", "block", "bottom", "box", "container", "inner", "item", "left", "list", "outer", "page", "panel", "primary",
    "right", "secondary", "site", "slot", "text", "title", "top", "wrap", "wrapper",
}
END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Block:
    """A block: its text, how much of it is links, its element and that one's parent, what the names around it say
    (boilerplate from 0 to 1, content), its depth, and its distance from the block before."""

    __slots__ = ("text", "linked", "tag", "parent", "boiler", "content", "depth", "distance")

    def __init__(self, text: str, linked: int, tag: str, parent: int, boiler: float, content: float, depth: int, distance: int):
        self.text, self.linked, self.tag, self.parent = text, linked, tag, parent
        self.boiler, self.content, self.depth, self.distance = boiler, content, depth, distance


def said(tag: str, attributes: str) -> tuple[float, float]:
    """How far an element's name and attributes say boilerplate, and content, from 0 to 1.

    A name with other words in it than those of boilerplate and places (``related-work``) says it by half.
    """
    boiler, content = float(tag in BOILER_TAGS), float(tag in CONTENT_TAGS)
    if attributes and tag not in ("html", "body"):
        for value in NAMED.findall(attributes):
            for name in value.strip("\"'").split():
                words = {w.lower() for w in PARTS.findall(name)}
                if not words.isdisjoint(BOILER_WORDS):
                    boiler = max(boiler, 1.0 if words <= BOILER_WORDS | PLACES else 0.5)
                elif not words.isdisjoint(CONTENT_WORDS):
                    content = 1.0
    return boiler, content


class Tags:
    """The tags of a page in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()  # what doesn't occur any more

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; quotes after an equals sign may hold others. -1 without any."""
        page = self.page
        while True:
            stop = self._find(">", at)
            if stop < 0:
                return -1
            opening = min((q for q in (page.find('"', at, stop), page.find("'", at, stop)) if q >= 0), default=-1)
            if opening < 0:
                return stop
            at = opening + 1
            if page[:opening].endswith("=") if opening < 2 else page[opening - 1] == "=" or page[opening - 2 : opening] == "= ":
                closing = self._find(page[opening], at)
                if closing >= 0:
                    at = closing + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, slash, name, attributes) of each tag; comments and declarations have no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            m = TAG.match(page, start + 1)
            if m:
                stop = self.end(m.end())
                if stop < 0:
                    return
                at = stop + 1
                name = m[2].lower()
                if name in RAW and not m[1] and page[stop - 1] != "/":
                    close = END_OF[name].search(page, at)
                    at = close.end() if close else len(page)
                yield start, at, m[1], name, page[m.end() : stop]
            elif page.startswith("<!--", start):
                stop = self._find("-->", start + 4)
                at = len(page) if stop < 0 else stop + 3
                yield start, at, "", "", ""
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                stop = self._find(">", start)
                if stop < 0:
                    return
                at = stop + 1
                yield start, at, "", "", ""
            else:
                at = start + 1


class Elements:
    """The open elements; every step takes constant time, or closes elements."""

    def __init__(self):
        # Each: tag, own number, boilerplate and content said around it, inside a link.
        self.open: list[tuple[str, int, float, float, bool]] = [("", 0, 0.0, 0.0, False)]
        self.blocks = [0]  # places of the open blocks
        self.scopes: list[dict[str, int]] = [{}]  # open inline elements within each of them
        self.counts: dict[str, int] = {}  # open blocks by tag
        self.number = 0
        self.low = 1  # fewest open elements since the last block of text

    def push(self, tag: str, attributes: str) -> None:
        _, _, boiler, content, link = self.open[-1]
        more, good = said(tag, attributes)
        if tag in BLOCK:
            self.blocks.append(len(self.open))
            self.scopes.append({})
            self.counts[tag] = self.counts.get(tag, 0) + 1
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        self.number += 1
        self.open.append((tag, self.number, max(boiler, more), max(content, good), link or tag == "a"))

    def pop(self) -> str:
        tag = self.open.pop()[0]
        if self.blocks[-1] == len(self.open):
            self.blocks.pop()
            self.scopes.pop()
            self.counts[tag] -= 1
        else:
            self.scopes[-1][tag] -= 1
        self.low = min(self.low, len(self.open))
        return tag

    def innermost(self) -> str:
        return self.open[self.blocks[-1]][0]

    def close_innermost(self) -> None:
        place = self.blocks[-1]
        while len(self.open) > place:
            self.pop()

    def close(self, tag: str) -> None:
        """An end tag: closes up to its element, if one is open (an inline one only within its block)."""
        held = self.counts if tag in BLOCK else self.scopes[-1]
        if held.get(tag):
            while self.pop() != tag:
                pass


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    page = page or ""
    out: list[Block] = []
    elements = Elements()
    held: list[str] = []
    linked = at = before = 0

    def end() -> None:
        nonlocal linked, before
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                place = elements.blocks[-1]
                tag, _, boiler, content, _ = elements.open[place]
                parent = elements.open[max(0, place - 1)][1]
                low = min(elements.low, place + 1)
                out.append(Block(text, linked, tag, parent, boiler, content, place, max(0, before - low) + place + 1 - low + 1))
                before, elements.low = place + 1, place + 1
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if elements.open[-1][4]:
                linked += len(text.strip())

    for start, after, slash, name, attributes in Tags(page):
        if start > at:
            say(page[at:start])
        at = after
        if not name:
            continue
        if slash:
            if name in BLOCK:
                end()
            elements.close(name)
        elif name in RAW:
            if name in ("button", "select"):
                held.append(" ")
        elif name in VOID:
            if name == "hr":
                end()
            elif name == "br":
                held.append(" ")
        else:
            if name in BLOCK:
                end()
                closes = CLOSES.get(name, ("p",))
                while elements.innermost() in closes:
                    elements.close_innermost()
            elements.push(name, attributes)
    say(page[at:])
    end()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """What the classifier sees of each block; the last two columns are what the names around it say.

    The other columns count as far as those names don't say boilerplate.
    """
    n = len(blocks)
    boiler = np.array([b.boiler for b in blocks], float)
    size = np.array([len(b.text) for b in blocks], float)
    found = np.stack(
        [
            np.ones(n),
            np.log1p(size) / 5,
            np.array([min(1.0, b.linked / max(1, len(b.text))) for b in blocks]),
            np.array([sum(map(b.text.count, ".!?,;")) for b in blocks]) / np.maximum(size, 1) * 20,
            np.array([b.text[-1] in ".!?" for b in blocks], float),
            np.array([b.tag in ("p", "blockquote", "pre") for b in blocks], float),
            np.array([b.tag in HEADINGS for b in blocks], float),
            np.array([b.tag in ("li", "dd", "dt", "td") for b in blocks], float),
            np.minimum([b.depth for b in blocks], 30) / 10,
            boiler,
            np.array([b.content for b in blocks], float),
        ],
        axis=1,
    )
    found[:, 1:-2] *= 1 - boiler[:, None]
    found[:, -1] *= 1 - boiler
    return found


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut (the smallest such side), by Dinic's maximum flow."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    left: list[float] = []  # what each arc can still carry; its reverse is its neighbour
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((forth, back))

    for k in range(n):
        gain = source[k] - sink[k]  # what flows straight through changes nothing
        if gain > 0:
            join(s, k, gain, 0.0)
        elif gain < 0:
            join(k, t, -gain, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)

    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in arcs[u]:
                v = to[e]
                if level[v] < 0 and left[e] > 1e-9:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)  # each node's first arc that may still carry more
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min([left[e] for e in path])
                first = 0
                for k, e in enumerate(path):
                    left[e] -= push
                    left[e ^ 1] += push
                    if left[e] <= 1e-9 and not first:
                        first = k + 1
                del path[first - 1 :]
                u = to[path[-1]] if path else s
            elif at[u] < len(arcs[u]):
                e = arcs[u][at[u]]
                if left[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    at[u] += 1
            elif path:
                path.pop()
                u = to[path[-1]] if path else s
                at[u] += 1
            else:
                break


class PageModel:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def gains(self, blocks: list[Block]) -> list[float]:
        """The log-odds of each block."""
        most = float(np.log((1 - NOISE) / NOISE))
        return np.clip(features(blocks) @ self.weights, -most, most).tolist()

    @staticmethod
    def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
        """The smoothness edges: (block, block, capacity)."""
        edges, last = [], {}
        for k, b in enumerate(blocks):
            if k:
                edges.append((k - 1, k, BESIDE * FALL ** max(0, b.distance - 2)))
            before = last.get(b.parent)
            if before is not None and before != k - 1:
                edges.append((before, k, FOLLOWING))
            last[b.parent] = k
        return edges

    def keep(self, blocks: list[Block]) -> list[bool]:
        """Which blocks are content."""
        if not blocks:
            return []
        gain = self.gains(blocks)
        return minimum_cut([max(c, 0.0) for c in gain], [max(-c, 0.0) for c in gain], self.edges(blocks))

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, own in zip(blocks, self.keep(blocks)) if own)


def train(pages: list[str]) -> PageModel:
    """Logistic regression on the blocks whose surroundings say what they are, with and without those names."""
    found = [b for p in pages for b in blocks_of(p)]
    own = [b for b in found if b.boiler == 1 or (b.content and not b.boiler)]
    width = features([Block(".", 0, "", 0, 0, 0, 0, 0)]).shape[1]
    if not own:
        return PageModel(np.zeros(width))
    x = features(own)
    good = np.array([b.boiler < 1 for b in own])
    blind = x.copy()
    blind[:, -2:] = 0
    x, good = np.concatenate([x, blind]), np.concatenate([good, good])
    y = np.where(good, 1 - NOISE, NOISE)
    weight = np.where(good, 0.5 / max(1e-9, good.mean()), 0.5 / max(1e-9, 1 - good.mean())) / len(y)
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, STEPS + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return PageModel(w)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> PageModel:
    """Fit on about TRAIN_PAGES pages of at most MAX_CHARS characters, picked by a hash of the id."""
    share = TRAIN_PAGES / max(1, pages.count())
    picked = pages.where(
        (F.pmod(stable_order(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.length(html_col) <= MAX_CHARS)
    )
    return train([r[0] for r in picked.select(html_col).collect()])


def extracted(pages: DataFrame, model: PageModel, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [held.value.text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
