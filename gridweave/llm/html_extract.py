"""Main-text extraction: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A page is read into its block-level nodes. Every node gets features of its subtree (text per element, link share,
words per block, punctuation), its attribute and tag tokens (encoded by the log-odds they had in training), its depth,
its ancestors and its siblings. Gradient-boosted trees give the chance that a node holds main text. Decoding is a
dynamic program over the tree: a node is either dropped with all below it, or opened and its children decided; the
choice with the greatest total log-likelihood wins, so no node is kept under a dropped ancestor.

There are no labels for pages, so the training pages are made from a bounded sample of the given ones: their own texts
are set into pages whose parts are known by construction (main containers, menus, headers, footers, sidebars, notices,
adverts, forms, comments, with telling attributes, misleading ones or none). The sample's own markup is kept too
wherever it names its parts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm._spark import ship
from gridweave.llm._text import chunks

#: Pages that a model is trained from at most, and their characters together; words of a text that made pages hold.
SAMPLE = 300
SAMPLE_CHARS = 32_000_000
PIECE = 400
# Fixed values of the HTML standard: void elements, raw-text elements, block-level elements, what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
IN_HEAD = RAW | frozenset("base basefont bgsound link meta noscript template noframes".split())
#: Drawings, inert parts and the options of forms: gone with all inside, if they are closed.
SKIPPED = frozenset("svg template datalist".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split())
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_CLOSE_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "button", "legend", "html", "body"}
_WALLS = frozenset("table ul ol dl td th html body".split())
_SELECT_END = re.compile(r"(</select\b[^>]*>)|<select\b|</form\b", re.I)
_BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCKS - {'hr'}, key=len, reverse=True))})\b", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...]
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Block-level nodes in document order, and the blocks of text as (node, text, characters inside links)."""

    nodes: list[Node]
    blocks: list[tuple[int, str, int]]


def _tokens(attributes: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in _TOKEN.findall(m[2] or m[3] or m[4] or ""))) if "=" in attributes else ()


@lru_cache(16)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


@lru_cache(16)
def _either(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I)


def _behind(html: str, tag: str, at: int) -> int:
    """Where the element that was opened before ``at`` ends, with others of its name inside it; ``at`` if it never does."""
    depth = 1
    for m in _either(tag).finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return at


def _select_end(html: str, at: int) -> int:
    """Where a select that was opened before ``at`` ends: at its end tag, or, if another select or the form's end comes
    before that, there or where a block-level element begins. One that nothing ends hides nothing if a block-level
    element follows, else what is left of the page."""
    border = _SELECT_END.search(html, at)
    if border and border[1]:
        return border.end()
    stop = border.start() if border else len(html)
    block = _BLOCK_START.search(html, at, stop)
    if not border:
        return at if block else stop
    return block.start() if block else stop


def parse(html: str) -> Page:
    """The page's nodes and blocks. Scripts, styles, comments, markup and the head are gone; unclosed tags are closed.

    A head ends at the first tag or text that cannot stand in it. Raw text (script, style, ...) without an end tag goes to
    the page's end, as browsers read it; a drawing without one hides nothing; a select without one ends at the next select,
    at the form's end or where a block-level element begins before these, and hides nothing if only the page's end and
    block-level elements follow. What other elements hold for
    readers without them (math, object, audio, video, canvas, noscript) is text.
    """
    nodes, blocks = [Node("html", -1, 0, ())], []
    stack = [("html", 0)]  # open elements: tag, block-level node it belongs to
    text: list[str] = []
    linked = links = 0
    head = False
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack of open elements by tag, so that none is searched for
    walls: list[int] = []  # and of those that end tags of inline elements do not reach beyond
    blocky: list[int] = []  # and of block-level ones

    def flush() -> None:
        nonlocal linked
        if text:
            if clean := _BLANK.sub(" ", "".join(text)).strip():
                blocks.append((stack[-1][1], clean, min(linked, len(clean))))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, head
        if head:
            head = not raw.strip()
        if raw and not head:
            plain = entities.unescape(raw)
            text.append(plain)
            if links:
                linked += len(plain.strip())

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > max(1, to):
            tag, _ = stack[-1]
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            stack.pop()
            for places in (opened[tag], walls, blocky):
                if places and places[-1] == len(stack):
                    places.pop()

    def push(tag: str, node: int) -> None:
        for places in (opened[tag], *[walls] * (tag in _WALLS), *[blocky] * (tag in BLOCKS)):
            places.append(len(stack))
        stack.append((tag, node))

    def last(tags) -> int:
        """The place of the nearest open element of these tags, 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    at, end = 0, len(html)
    unclosed: set[str] = set()
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:  # an end tag closes the nearest open element of its name
            if tag in ("head", "body"):
                head = False
            if tag == "p" and not opened["p"]:
                flush()
            if not opened[tag]:
                continue
            if tag in BLOCKS or not walls or walls[-1] <= opened[tag][-1]:
                pop(opened[tag][-1])
            continue
        if tag == "head":
            head = True
            continue
        head = head and tag in IN_HEAD
        if tag in RAW:
            close = _closing(tag).search(html, at)
            at = end if close is None else close.end()
            continue
        if tag == "select":
            at = _select_end(html, at)
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/") and tag not in unclosed:
                behind = _behind(html, tag, at)
                if behind == at:  # nor does any of its name behind it, at this depth
                    unclosed.add(tag)
                at = behind
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in _CLOSE_P and opened["p"] and (not blocky or blocky[-1] <= opened["p"][-1]):
            pop(opened["p"][-1])
        if tag in CLOSED_BY and (to := last(CLOSED_BY[tag])) and to >= last(("ul", "ol", "dl", "table")):
            pop(to)
        if tag in BLOCKS:
            flush()
            if tag == "hr" or tag == "html":
                continue
            parent = stack[-1][1]
            nodes[parent].children.append(len(nodes))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, _tokens(m[3])))
            push(tag, len(nodes) - 1)
        elif not (m[3].endswith("/") and opened["math"]):  # an empty element of a formula
            links += tag == "a"
            push(tag, stack[-1][1])
    flush()
    return Page(nodes, blocks)


FEATURES = 24


def _log(x) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row a node."""
    n = len(page.nodes)
    size, linked, count, marks, words = (np.zeros(n) for _ in range(5))
    for node, text, inside in page.blocks:
        size[node] += len(text)
        linked[node] += inside
        count[node] += 1
        marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        words[node] += text.count(" ") + 1
    own = size.copy()
    below = np.ones(n)
    parent = np.array([x.parent for x in page.nodes])
    for i in range(n - 1, 0, -1):  # children come after parents
        p = parent[i]
        for v in (size, linked, count, marks, words, below):
            v[p] += v[i]
    code = lambda t: odds.get(t, 0.0)
    tag = np.array([code("<" + x.tag) for x in page.nodes])
    attributes = [[code(t) for t in x.tokens] for x in page.nodes]
    worst = np.array([min(a, default=0.0) for a in attributes])
    best = np.array([max(a, default=0.0) for a in attributes])
    mean = np.array([sum(a) / len(a) if a else 0.0 for a in attributes])
    above_tag, above_worst, above_best = tag.copy(), worst.copy(), best.copy()
    place, brothers, alike, before = (np.zeros(n) for _ in range(4))
    for i in range(1, n):
        p = parent[i]
        above_tag[i], above_worst[i], above_best[i] = min(tag[i], above_tag[p]), min(worst[i], above_worst[p]), max(best[i], above_best[p])
    for x in page.nodes:
        same: dict[str, int] = defaultdict(int)
        for c in x.children:
            same[page.nodes[c].tag] += 1
        seen = 0.0
        for k, c in enumerate(x.children):
            place[c], brothers[c], alike[c], before[c] = (k + 0.5) / len(x.children), len(x.children), same[page.nodes[c].tag] / len(x.children), seen
            seen += size[c]
    total = max(1.0, size[0])
    up = np.maximum(parent, 0)
    heading = np.array([x.tag in ("h1", "h2", "h3", "h4") for x in page.nodes])
    return np.stack(
        [
            tag, worst, best, mean, tag[up], above_tag, above_worst, above_best,
            np.array([x.depth for x in page.nodes], float), _log(size), size / total, _log(size / below), linked / np.maximum(1, size), linked[up] / np.maximum(1, size[up]),
            _log(words / np.maximum(1, count)), marks / np.maximum(1, words), _log(below), _log(own), place, _log(brothers), alike, before / np.maximum(1, size[up]), size / np.maximum(1, size[up]), heading.astype(float),
        ],
        axis=1,
    )


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for a yes-or-no target, over at most 32 bins a feature."""

    def __init__(self, depth: int = 4, rounds: int = 80, rate: float = 0.2, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.ridge = depth, rounds, rate, ridge
        self.feature, self.cut, self.leaf, self.base = [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]) if len(x) else np.zeros((x.shape[1], 0), int)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            at = np.zeros(len(y), int)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                chosen = np.full(many, -1)
                where = np.zeros(many, int)
                for k in range(len(binned)):
                    if not len(edges[k]):
                        continue
                    slot = (at - first) * 33 + binned[k]
                    gs, hs = (np.bincount(slot, v, many * 33).reshape(many, 33).cumsum(axis=1) for v in (g, h))
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain = gain[:, : len(edges[k])]
                    top = gain.argmax(axis=1)
                    more = gain[np.arange(many), top]
                    take = more > best
                    best[take], chosen[take], where[take] = more[take], k, top[take]
                for i in np.flatnonzero(chosen >= 0):
                    feature[first + i], cut[first + i] = chosen[i], edges[chosen[i]][where[i]]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            slot = at - (2**self.depth - 1)
            leaf = self.rate * np.bincount(slot, g, 2**self.depth) / (np.bincount(slot, h, 2**self.depth) + self.ridge)
            f += leaf[slot]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            f += leaf[at - (2**self.depth - 1)]
        return f


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: BoostedTrees

    def texts(self, pages: list[Page]) -> list[str]:
        """The main text of each page: kept blocks in page order, joined by newlines."""
        if not pages:
            return []
        decided = self.trees.decide(np.concatenate([features(p, self.odds) for p in pages]))
        out, at = [], 0
        for p in pages:
            kept = decode(p, decided[at : at + len(p.nodes)])
            at += len(p.nodes)
            out.append("\n".join(t for node, t, _ in p.blocks if kept[node]))
        return out


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes are open, by the tree's best total log-likelihood; below a dropped node nothing is open."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    n = len(page.nodes)
    below, best = drop.copy(), keep.copy()
    for i in range(n - 1, 0, -1):
        p = page.nodes[i].parent
        below[p] += below[i]
        best[p] += max(below[i], best[i])
    open_ = [False] * n
    for i, x in enumerate(page.nodes):
        open_[i] = (i == 0 or open_[x.parent]) and best[i] >= below[i]
    return open_


# Tokens that pages use for their parts, used to set training pages.
MAIN = ("article", "post content", "entry content", "article body", "story", "main content", "post", "content", "text body", "prose", "single", "markdown")
PARTS = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumbs", "topnav", "main menu", "tabs", "links"),
    "header": ("header", "masthead", "site header", "top bar", "branding", "site title", "hero"),
    "footer": ("footer", "site footer", "copyright", "colophon", "bottom", "legal"),
    "aside": ("sidebar", "side", "widget", "related", "recommended", "trending", "more stories", "tags", "author box"),
    "notice": ("notice", "cookie", "cookie banner", "alert", "consent", "newsletter", "subscribe", "modal", "popup", "gdpr", "banner"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "ad slot", "banner ad"),
    "form": ("form", "search", "login", "signup", "contact form", "comment form"),
    "comments": ("comments", "comment list", "discussion", "responses", "replies", "reader comments", "comment"),
    "share": ("share", "social", "share buttons", "follow", "toolbar", "pagination", "pager"),
}
NATIVE = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


def _named(rng, tag: str, names: tuple[str, ...], inner: str, plain: float = 0.15) -> str:
    if rng.random() < plain:
        return f"<{tag}>{inner}</{tag}>"
    name = names[rng.integers(len(names))]
    key = ("class", "id", "class", "role" if rng.random() < 0.2 else "class")[rng.integers(4)]
    return f'<{tag} {key}="{name.replace(" ", "-_ "[rng.integers(3)])}">{inner}</{tag}>'


def training_page(rng, texts: list[str]) -> tuple[str, list[str]]:
    """A page of the given texts, whose main blocks hold the mark U+E000; its parts are drawn at random."""
    pick = lambda: entities.escape(texts[rng.integers(len(texts))])
    words = lambda k: " ".join(pick().split()[: 1 + rng.integers(k)])

    def links(k: int) -> str:
        items = [f'<a href="/{i}">{words(4)}</a>' for i in range(k)]
        return "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if rng.random() < 0.6 else " ".join(items)

    def part(kind: str) -> str:
        body = {
            "nav": lambda: links(3 + rng.integers(8)),
            "header": lambda: f"<{(t := ('h1', 'p', 'div')[rng.integers(3)])}>{words(5)}</{t}>" + (links(4) if rng.random() < 0.4 else ""),
            "footer": lambda: f"&copy; {words(12)}" if rng.random() < 0.5 else f"<p>{words(12)}</p>" + (links(3) if rng.random() < 0.5 else ""),
            "aside": lambda: f"<h3>{words(4)}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{words(25)}</p>"),
            "notice": lambda: f"<p>{words(20)}</p><button>{words(2)}</button>" if rng.random() < 0.5 else words(20),
            "ad": lambda: words(15) if rng.random() < 0.6 else f"<p>{words(20)}</p>",
            "form": lambda: f'<label>{words(3)}</label><input name="q"><button>{words(2)}</button>',
            "comments": lambda: f"<h3>{words(3)}</h3>" + "".join(_named(rng, ("div", "li", "article")[rng.integers(3)], ("comment", "reply", "response"), f"<p>{words(3)}</p><p>{words(40)}</p>") for _ in range(1 + rng.integers(4))),
            "share": lambda: links(2 + rng.integers(4)),
        }[kind]()
        if kind in NATIVE and rng.random() < 0.55:
            return _named(rng, NATIVE[kind], PARTS[kind], body, 0.6)
        return _named(rng, ("div", "section", "ul" if "<li>" in body and rng.random() < 0.2 else "div", "aside" if kind == "ad" else "div")[rng.integers(4)], PARTS[kind], body)

    def block() -> str:
        kind = rng.random()
        text = f"{pick()}"
        if kind < 0.7:
            return f"<p>{text}</p>" if rng.random() < 0.8 else f'<p><b>{text}<br>'
        if kind < 0.78:
            return f"<h2>{words(6)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{words(12)}</li>" for _ in range(2 + rng.integers(4))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{text}</blockquote>"
        return f'<p>{text} <a href="/x">{words(3)}</a>.</p>'

    inner = [block() for _ in range(1 + rng.integers(12))]
    if rng.random() < 0.8:
        inner.insert(0, f"<h1>{words(10)}</h1>")
    for kind in ("ad", "notice", "aside", "share", "comments", "form"):
        if rng.random() < 0.2:
            inner.insert(1 + rng.integers(len(inner)), part(kind))
    tag = ("article", "main", "div", "section", "div")[rng.integers(5)]
    main = _named(rng, tag, MAIN, "".join(inner), 0.6 if tag in ("article", "main") else 0.1)
    front = [part(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
    back = [part(k) for k in ("aside", "comments", "ad", "share", "notice", "form", "footer") if rng.random() < 0.45]
    rng.shuffle(front)
    if rng.random() < 0.3:
        main = f'<div class="{("wrap", "container", "row", "page", "layout")[rng.integers(5)]}">{main}{"".join(back[:1])}</div>'
        back = back[1:]
    return f"<html><head><title>t</title></head><body>{''.join(front)}{main}{''.join(back)}</body></html>"


def _known(page: Page) -> np.ndarray | None:
    """For a real page that names its parts: which nodes hold main text. None where it has no single main element."""
    mains = [i for i, x in enumerate(page.nodes) if x.tag in ("article", "main")]
    if len(mains) != 1:
        return None
    y = np.zeros(len(page.nodes), bool)
    inside = np.zeros(len(page.nodes), bool)
    for i, x in enumerate(page.nodes):
        inside[i] = (i == mains[0] or (x.parent >= 0 and inside[x.parent])) and x.tag not in ("nav", "aside", "footer", "form")
    for node, _, _ in page.blocks:
        while inside[node] and node >= 0 and not y[node]:
            y[node] = True
            node = page.nodes[node].parent
            if node == page.nodes[mains[0]].parent:
                break
    node = page.nodes[mains[0]].parent
    while node >= 0 and y[mains[0]]:
        y[node] = True
        node = page.nodes[node].parent
    return y


def _pieces(text: str) -> list[str]:
    words = text.split(" ")
    return [" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE)]


def fit(sample: list[str], made: int = 700, seed: int = 7) -> Extractor:
    """An extractor from sample pages; an empty sample gives one that was trained on pages of a few stock words."""
    rng = np.random.default_rng(seed)
    real = [parse(h) for h in sample]
    texts = [x for p in real for _, t, _ in p.blocks if " " in t for x in _pieces(t.replace("", ""))] or ["one text of a few plain words, set into pages.", "another one. it has more words, and commas, than the first one."]
    pages: list[Page] = []
    labels: list[np.ndarray] = []
    for _ in range(made):
        page = parse(training_page(rng, texts))
        y = np.zeros(len(page.nodes), bool)
        for node, text, _ in page.blocks:
            if "" in text:
                while node >= 0 and not y[node]:
                    y[node], node = True, page.nodes[node].parent
        page.blocks = [(n, t.replace("", ""), k) for n, t, k in page.blocks]
        pages.append(page)
        labels.append(y)
    for page in real:
        if (y := _known(page)) is not None:
            pages.append(page)
            labels.append(y)
    seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for page, y in zip(pages, labels, strict=True):
        for node, is_main in zip(page.nodes, y, strict=True):
            for t in ("<" + node.tag, *node.tokens):
                seen[t][int(is_main)] += 1
    odds = {t: math.log((main + 1) / (other + 1)) for t, (other, main) in seen.items()}
    return Extractor(odds, BoostedTrees().fit(np.concatenate([features(p, odds) for p in pages]), np.concatenate(labels).astype(float)))


def train(pages: DataFrame, sample: int = SAMPLE) -> Extractor:
    """Fits on at most ``sample`` pages, by hash order of page_id, and of these on as many as have ``SAMPLE_CHARS`` together.

    Ids are chosen first, so only these pages move.
    """
    ids = pages.filter("html is not null and page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    sizes = rows.select("page_id", F.length("html").alias("n"), F.xxhash64("page_id").alias("h")).collect()  # ``sample`` rows at most
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.page_id)):
        total += r.n
        if total <= SAMPLE_CHARS:
            fits.append(r.page_id)
    rows = rows.filter(F.col("page_id").isin(fits))
    return fit([r.html for r in sorted(rows.collect(), key=lambda r: r.page_id)])


def _extract(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for part, raw in chunks(batches, "html", 1_000_000):
        texts = model.value.texts([parse(h.decode()) for h in raw])
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, sample: int = SAMPLE, extractor: Extractor | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by one
    newline; nothing is capped. Null and empty pages have an empty text. Repeated rows give repeated rows, null ids and
    urls stay null, an empty table gives an empty result. The model is a broadcast of fixed size.
    """
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(extractor or train(pages, sample))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(lambda it: _extract(it, model), "page_id long, url string, text string, n_chars long")
