"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into block elements and runs of text. Two ensembles of gradient-boosted
trees look at each node (subtree density, links, attribute tokens, depth, siblings): one
for "holds some main text", one for "holds main text only". Decoding picks the most
likely labelling in which every descendant of a kept element is kept and every descendant
of a dropped element is dropped; only mixed elements leave the choice to their children.

There are no labelled pages, so training lays the sentences of a bounded sample of the
pages (``max_pages``, chosen by a hash; at most ``max_sentences``) out anew: as paragraphs,
headings, lists, tables, preformatted and bare text, in articles, under unknown class names or
straight in the body, and as the menus, adverts, notices, sidebars, comments and footers around
and inside them; there every node's label is known. Every page is extracted from its whole html.

Rows: null, empty and text-free html gives the empty text. A page that repeats is
extracted each time. Unclosed, misnested and unknown tags are read leniently; script,
style, head and form controls hold no text. A head without an end tag ends before the first
element of the body, a form control or the like without one before the next block or with
its parent. Without any page to learn from there is nothing to extract. Extra columns of
``pages`` are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- parsing -----------------------------------------------------------------------------

_MARKUP = re.compile(
    # a quote counts behind "=" only, and only if it ends somewhere
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATOM = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
#: Elements whose content is no text of the page.
_SILENT = frozenset("script style head noscript template textarea select button svg iframe object title".split())
#: Of these, the content is no markup: without an end tag they reach to the end of the page.
_RAW = frozenset("script style title textarea iframe".split())
#: Elements that a head can hold; any other one ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption nav "
    "header footer aside form fieldset blockquote pre figure figcaption address details summary center".split()
)
#: An element of the first kind ends an open one of the second, up to the given limits.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


@dataclass
class Page:
    """Nodes in page order, parents before children; a run of text is a node with the tag ``#text``."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str = "", text: str = "", link_chars: int = 0, links: int = 0):
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.text.append(text)
        self.link_chars.append(link_chars)
        self.links.append(links)
        return len(self.tag) - 1


class _Builder:
    """Open elements and the run of text that is being read."""

    def __init__(self):
        self.page = Page()
        root = self.page.add("#root", -1)
        self.open: list[tuple[str, int]] = [("#root", root)]  # tag, and node of the nearest block
        self.n_open: Counter[str] = Counter()  # open elements by tag
        self.run: list[str] = []
        self.link_depth = self.run_links = self.run_link_chars = 0

    def words(self, raw: str) -> None:
        plain = html.unescape(raw) if "&" in raw else raw
        self.run.append(plain)
        if self.link_depth:
            self.run_link_chars += len(plain.strip())

    def flush(self) -> None:
        if self.run:
            text = _WHITE.sub(" ", "".join(self.run)).strip()
            if text:
                self.page.add("#text", self.open[-1][1], "", text, self.run_link_chars, self.run_links)
            self.run = []
        self.run_links = self.run_link_chars = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.run.append(" ")
        if tag in _VOID:
            return
        if tag in _BLOCK:
            self.flush()
            if tag in _ENDS:
                self.end_open(*_ENDS[tag])
            else:
                self.end_open({"p"}, {"td", "th", "div", "article", "section", "li", "blockquote"})
            found = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ""
            self.push(tag, self.page.add(tag, self.open[-1][1], found.lower()))
            return
        if tag == "a":
            self.link_depth += 1
            self.run_links += 1
        self.push(tag, self.open[-1][1])

    def push(self, tag: str, node: int) -> None:
        self.open.append((tag, node))
        self.n_open[tag] += 1

    def end_open(self, tags: set[str], limits: set[str]) -> None:
        if not any(self.n_open[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self.close_to(k)
                return
            if self.open[k][0] in limits:
                return

    def end(self, tag: str) -> None:
        if not self.n_open[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in _BLOCK or any(t in _BLOCK for t, _ in self.open[k:]):
                    self.flush()
                self.close_to(k)
                return

    def close_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.n_open[tag] -= 1
            self.link_depth -= tag == "a"
        del self.open[k:]


def _after(tag: str, source: str, at: int) -> int:
    """The place after the element's end tag, or the end of the page."""
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(source, at).end()


def _after_head(source: str, at: int) -> int:
    """The place after the head's end tag; ``at`` if the body begins without one."""
    inside: list[str] = []  # open noscript and template elements
    for_next = at
    while m := _MARKUP.search(source, for_next):
        for_next = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "head":
                return m.end()
            if tag in inside:
                del inside[inside.index(tag) :]
        elif m[2]:
            tag = m[2].lower()
            if tag == "body" or (tag not in _IN_HEAD and not inside):
                return at
            if not m[3].endswith("/"):
                if tag in _RAW:
                    for_next = _after(tag, source, m.end())
                elif tag in ("noscript", "template"):
                    inside.append(tag)
    return at


def _closed(tag: str, source: str) -> set[int]:
    """The places after those start tags of ``tag`` that have an end tag of their own."""
    open_at: list[int] = []
    found = set()
    for m in _MARKUP.finditer(source):
        if m[1] and m[1].lower() == tag and open_at:
            found.add(open_at.pop())
        elif m[2] and m[2].lower() == tag and not m[3].endswith("/"):
            open_at.append(m.end())
    return found


def parse(source: str | None) -> Page:
    """The page's tree of blocks and text runs."""
    b = _Builder()
    source = source or ""
    at = 0
    silent: list[str] = []  # open elements from a silent one on
    lasting = False  # the silent element has an end tag
    closed: dict[str, set[int]] = {}
    last = max(source.rfind(">"), source.find("<!--"))  # behind it no markup ends
    while True:
        m = _MARKUP.search(source, at) if at <= last else None
        end = m.start() if m else len(source)
        if end > at and not silent:
            b.words(source[at:end])
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in silent:
                del silent[len(silent) - 1 - silent[::-1].index(tag) :]
                continue
            if silent and (tag in _BLOCK or not lasting) and any(t == tag for t, _ in b.open):
                silent = []  # ends with its parent
            b.end(tag)
        elif m[2]:
            tag = m[2].lower()
            if silent and not lasting and tag in _BLOCK:
                silent = []
            if tag in _SILENT or silent:
                if m[3].endswith("/") or tag in _VOID:
                    continue
                if tag in _RAW:
                    at = _after(tag, source, at)
                elif silent:
                    silent.append(tag)
                elif tag == "head":
                    at = _after_head(source, at)
                else:
                    if tag not in closed:
                        closed[tag] = _closed(tag, source)
                    silent, lasting = [tag], at in closed[tag]
            else:
                b.start(tag, m[3])
    b.flush()
    return b.page


# -- features ----------------------------------------------------------------------------

#: Kinds of elements that the trees tell apart.
_KINDS = (
    ("#text",),
    ("p",),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("article", "main"),
    ("section",),
    ("div", "center", "details"),
    ("ul", "ol", "dl"),
    ("li", "dt", "dd"),
    ("table", "thead", "tbody", "tr", "td", "th", "caption"),
    ("nav",),
    ("header",),
    ("footer", "address"),
    ("aside",),
    ("form", "fieldset"),
    ("blockquote", "pre", "figure", "figcaption"),
)
_KIND = {t: k for k, tags in enumerate(_KINDS) for t in tags}
#: Groups of words in class, id and role, each a feature; a word counts by how it begins.
_ATOMS = (
    ("ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promoted"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "tabs", "toc", "pagination", "pager"),
    ("header", "masthead", "top", "topbar", "site", "logo", "branding"),
    ("footer", "bottom", "copyright", "legal", "colophon"),
    ("sidebar", "side", "aside", "widget", "widgets", "rail", "column", "secondary", "complementary"),
    ("comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "reader", "feedback"),
    ("cookie", "cookies", "consent", "notice", "notification", "alert", "warning", "popup", "modal", "overlay", "gdpr"),
    ("share", "social", "follow", "twitter", "facebook", "related", "recommended", "popular", "trending", "tags", "more"),
    ("newsletter", "subscribe", "signup", "login", "search", "form", "contact", "register"),
    ("article", "content", "post", "entry", "story", "text", "body", "main", "page", "wrapper", "container"),
)
_ATOM_GROUP = {w: k for k, words in enumerate(_ATOMS) for w in words}
_END_MARKS = re.compile(r"[.!?;:]")


def features(page: Page) -> np.ndarray:
    """One row per node: kind and attribute groups of the node and its parent, groups of all
    its ancestors, sums over the subtree, place among the siblings."""
    n = len(page.tag)
    parent = np.array(page.parent)
    kind = np.zeros((n, len(_KINDS)), np.float32)
    group = np.zeros((n, len(_ATOMS)), np.float32)
    above = np.zeros((n, len(_ATOMS)), np.float32)
    depth = np.zeros(n, np.float32)
    sums = np.zeros((n, 6))  # chars, link chars, links, text runs, elements, sentence ends
    place = np.zeros(n, np.float32)
    children = np.zeros(n, np.float32)
    alike: dict[tuple[int, str], int] = {}
    for k in range(n):
        tag, up = page.tag[k], page.parent[k]
        if tag in _KIND:
            kind[k, _KIND[tag]] = 1
        for w in _ATOM.findall(page.attributes[k]):
            if w in _ATOM_GROUP:
                group[k, _ATOM_GROUP[w]] = 1
        if up >= 0:
            depth[k] = depth[up] + 1
            above[k] = np.maximum(above[up], group[up])
            place[k] = children[up]
            children[up] += 1
            alike[up, tag] = alike.get((up, tag), 0) + 1
        if tag == "#text":
            t = page.text[k]
            sums[k] = (len(t), page.link_chars[k], page.links[k], 1, 0, len(_END_MARKS.findall(t)))
        else:
            sums[k, 4] = 1
    for k in range(n - 1, 0, -1):
        sums[parent[k]] += sums[k]
    same = np.array([alike.get((p, t), 0) for p, t in zip(page.parent, page.tag, strict=True)], np.float32)
    up = np.maximum(parent, 0)
    chars = sums[:, 0]
    total = max(chars[0], 1.0)
    siblings = children[up]
    rows = [
        kind,
        group,
        kind[up],
        group[up],
        above,
        np.log1p(sums),
        np.c_[sums[:, 1] / np.maximum(chars, 1), chars / (sums[:, 4] + sums[:, 3]), chars / total],
        np.c_[depth, place, siblings, place / np.maximum(siblings, 1), same / np.maximum(siblings, 1), children],
        np.c_[chars / np.maximum(chars[up], 1), sums[:, 5] / np.maximum(chars, 1)],
    ]
    return np.concatenate(rows, axis=1).astype(np.float32)


# -- gradient-boosted trees --------------------------------------------------------------


@dataclass(frozen=True)
class GbtParams:
    trees: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 24
    min_leaf: float = 5.0
    l2: float = 1.0


@dataclass
class Gbt:
    """Complete trees of one depth: node k has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, p: GbtParams) -> Gbt:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        base = float(np.log(share / (1 - share)))
        inner = (1 << p.depth) - 1
        model = cls(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
        if not 0 < y.sum() < len(y):
            return model
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
        cuts = [np.unique(np.r_[c, 0.0, 0.5]).astype(np.float32) for c in cuts]
        width = max(map(len, cuts)) + 1
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        features, limits, leaves = [], [], []
        for _ in range(p.trees):
            prob = 1 / (1 + np.exp(-margin))
            f, c, v, at = _grow(binned, cuts, width, prob - y, prob * (1 - prob), p)
            margin += v[at]
            features.append(f)
            limits.append(c)
            leaves.append(v)
        return cls(base, np.array(features), np.array(limits, np.float32), np.array(leaves))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            margin += v[at - inner]
        return 1 / (1 + np.exp(-margin))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], width: int, g: np.ndarray, h: np.ndarray, p: GbtParams):
    """One tree on gradients and curvatures; a node without a useful split sends all rows left."""
    n_features = binned.shape[1]
    inner = (1 << p.depth) - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
    at = np.zeros(len(g), np.int64)
    first = 0
    for level in range(p.depth):
        nodes = 1 << level
        slot = (at - first) * width
        best = np.full(nodes, 1e-6)
        for f in range(n_features):
            key = slot + binned[:, f]
            gl = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
            hl = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
            gt, ht = gl[:, -1:], hl[:, -1:]
            gain = gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
            gain[(hl < p.min_leaf * 0.05) | (ht - hl < p.min_leaf * 0.05)] = 0
            k = gain[:, : len(cuts[f])].argmax(1)
            top = gain[np.arange(nodes), k]
            better = np.flatnonzero(top > best)
            best[better] = top[better]
            feature[first + better] = f
            cut[first + better] = cuts[f][k[better]]
        bin_cut = np.array([np.searchsorted(cuts[feature[i]], cut[i]) for i in range(first, first + nodes)])
        at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > bin_cut[at - first])
        first += nodes
    at -= inner
    leaf = -p.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + p.l2)
    return feature, cut, leaf, at


# -- training pages ----------------------------------------------------------------------

_ARTICLES = (
    "<article>",
    '<article class="post">',
    "<main>",
    '<div class="content">',
    '<div id="article-body">',
    '<div class="post-content entry">',
    '<section class="story">',
    '<div id="main">',
)
_WRAPPERS = ("<div>", '<div class="container">', '<div id="page">', '<div class="wrapper">', "<main>", "<section>")
_BOILERPLATE = {
    "menu": ("<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="navigation">', "<nav>"),
    "crumbs": ('<div class="breadcrumb">', '<nav class="breadcrumbs">'),
    "header": ("<header>", '<div id="header">', '<div class="masthead">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="copyright">', "<footer>"),
    "side": ("<aside>", '<div class="sidebar">', '<div class="widget">', '<aside class="widgets">'),
    "ad": ('<div class="ad">', '<div class="advert">', '<div class="banner">', '<p class="sponsored">', '<div class="ads promo">'),
    "notice": ('<div class="cookie-notice">', '<div class="alert">', '<div id="consent">', '<p class="notice">'),
    "form": ("<form>", '<form class="newsletter">', '<div class="subscribe">', '<div class="login form">'),
    "related": ('<div class="related">', '<section class="popular">', '<ul class="share social">', '<div class="tags">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<div class="discussion">', '<ol class="commentlist">'),
}
_KEEP, _DROP = ' data-label="zkeep"', ' data-label="zdrop"'


class _Layouts:
    """Random pages in which the elements of main text and of the rest carry a label attribute."""

    def __init__(self, sentences: list[str], seed: int):
        self.r, self.sentences = random.Random(seed), sentences

    def some(self, low: int, high: int) -> str:
        return html.escape(" ".join(self.r.choice(self.sentences) for _ in range(self.r.randint(low, high))), quote=False)

    def word(self) -> str:
        return html.escape((self.r.choice(self.sentences).split() or ["x"])[0], quote=False)

    def element(self, opening: str, inner: str, label: str = "") -> str:
        return f"{opening[:-1]}{label}>{inner}</{opening[1:].split()[0].rstrip('>')}>"

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/">{self.word()}</a></li>' for _ in range(self.r.randint(low, high)))

    def few(self, low: int = 1, high: int = 4) -> str:
        """A few words, as headings, cells, items and captions have them."""
        words = self.r.choice(self.sentences).split() or ["x"]
        first = self.r.randrange(len(words))
        found = words[first : first + self.r.randint(low, high)]
        if self.r.random() < 0.15:
            found = [str(self.r.randrange(10 ** self.r.randint(1, 5)))]
        return html.escape(" ".join(found), quote=False)

    def bit(self) -> str:
        """A few words or a sentence or two."""
        return self.few() if self.r.random() < 0.5 else self.some(1, 2)

    def unknown(self, tag: str) -> str:
        """A start tag, sometimes with a class that no list knows."""
        if self.r.random() < 0.7:
            return f"<{tag}>"
        name = "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 8)))
        return f'<{tag} class="{name}">' if self.r.random() < 0.7 else f'<{tag} id="{name}">'

    def table(self) -> str:
        columns = self.r.randint(1, 4)
        row = lambda t: "<tr>" + "".join(f"<{t}>{self.bit() if columns < 3 else self.few()}</{t}>" for _ in range(columns)) + "</tr>"
        head = row("th") if self.r.random() < 0.5 else ""
        return self.element(self.unknown("table"), head + "".join(row("td") for _ in range(self.r.randint(1, 6))))

    def paragraph(self) -> str:
        r = self.r.random()
        if r < 0.06:
            return f"<p><b>{self.some(1, 3)}<br><p>{self.some(1, 4)}</p>"
        if r < 0.12:
            return f'<p>{self.some(1, 3)} <a href="/">{self.word()}</a> {self.some(0, 2)}</p>'
        if r < 0.2:
            kind = self.r.choice(("ul", "ol"))
            return self.element(self.unknown(kind), "".join(f"<li>{self.bit()}</li>" for _ in range(self.r.randint(1, 6))))
        if r < 0.28:
            return self.element(f"<h{self.r.randint(2, 5)}>", self.few(1, 7) if self.r.random() < 0.7 else self.some(1, 1))
        if r < 0.36:
            return self.table()
        if r < 0.4:
            return self.element(self.r.choice(("<blockquote>", "<pre>", "<pre>")), self.bit())
        if r < 0.44:
            return self.element(self.unknown("div"), self.bit())
        if r < 0.48:
            return "<p>" + "<br>".join(self.bit() for _ in range(self.r.randint(2, 5))) + "</p>"
        if r < 0.51:
            return "<dl>" + "".join(f"<dt>{self.few()}</dt><dd>{self.bit()}</dd>" for _ in range(self.r.randint(1, 4))) + "</dl>"
        if r < 0.54:
            return f"<figure><img src=x><figcaption>{self.bit()}</figcaption></figure>"
        if r < 0.66:
            return self.element(self.unknown("p"), self.few(1, 6))
        return self.element(self.unknown("p"), self.some(1, 5))

    def boilerplate(self, what: str) -> str:
        opening = self.r.choice(_BOILERPLATE[what])
        if what in ("menu", "related", "crumbs"):
            inner = self.links(2, 8)
            inner = inner if opening.startswith(("<ul", "<ol")) else f"<ul>{inner}</ul>"
        elif what == "footer":
            inner = f"&copy; {self.word()}.example &middot; {self.some(0, 2)}"
        elif what == "header":
            inner = f'<a href="/">{self.word()}</a> {self.some(0, 1)}'
        elif what == "side":
            inner = f"<h3>{self.word()}</h3>" + self.r.choice((f"<p>{self.some(1, 2)}</p>", f"<ul>{self.links(2, 6)}</ul>"))
        elif what == "comments":
            one = self.r.choice(('<div class="comment">', '<li class="comment">', "<div>"))
            inner = "".join(
                self.element(one, f"<b>{self.word()}</b><p>{self.some(1, 3)}</p>") for _ in range(self.r.randint(1, 5))
            )
        elif what == "form":
            inner = f"<label>{self.some(0, 1)}</label><input><button>{self.word()}</button>"
        else:
            inner = self.some(1, 2)
        return self.element(opening, inner, _DROP)

    def parts(self) -> list[str]:
        r = self.r
        heading = [self.element(r.choice(("<h1>", "<h1>", "<h2>")), self.bit())] if r.random() < 0.8 else []
        n = r.choice((0, 1, 1, 2, 3, 5, 8, 12))
        return heading + [self.paragraph() for _ in range(n if heading else max(n, 1))]

    def article(self) -> str:
        """An element with the main text: all of it, or with strange parts inside."""
        r, parts = self.r, self.parts()
        opening = r.choice(_ARTICLES) if r.random() < 0.7 else self.unknown(r.choice(("article", "div", "section", "main")))
        if r.random() < 0.2:  # grouped once more
            k = r.randint(0, len(parts))
            parts = parts[:k] + [self.element(self.unknown(r.choice(("div", "section"))), "".join(parts[k:]) or self.some(1, 1))]
        inside = [w for w in ("ad", "related", "side", "notice", "comments") if r.random() < 0.12]
        if not inside:
            return self.element(opening, "".join(parts), _KEEP)
        # the article itself is mixed then; its own parts carry the labels
        marked = [re.sub(r"^<(\w+)", rf"<\1{_KEEP}", p) for p in parts]
        marked = [p.replace("<br><p>", f"<br><p{_KEEP}>") for p in marked]
        for w in inside:
            marked.insert(len(marked) if w == "comments" else r.randint(1, len(marked)), self.boilerplate(w))
        return self.element(opening, "".join(marked))

    def plain(self) -> str:
        """Main text without an element of its own: paragraphs, lines or bare text in the body."""
        r = self.r.random()
        if r < 0.35:
            return "".join(self.parts())
        if r < 0.5:
            return "<br>".join(self.bit() for _ in range(self.r.randint(1, 6)))
        if r < 0.65:
            return self.element(self.unknown("p"), self.bit())
        if r < 0.85:
            lines = [self.element(self.unknown("div"), self.bit()) for _ in range(self.r.randint(1, 5))]
            return self.element(self.unknown("div"), "".join(lines))
        return self.some(1, 5)

    def page(self) -> str:
        r = self.r
        # some pages are nothing but their text
        alone = r.random() < 0.15
        before = [w for w in ("header", "menu", "crumbs", "notice", "ad", "side") if not alone and r.random() < 0.45]
        after = [w for w in ("ad", "related", "comments", "form", "side", "footer", "notice") if not alone and r.random() < 0.35]
        r.shuffle(before)
        around = ["".join(map(self.boilerplate, names)) for names in (before, after)]
        if r.random() < 0.25:
            return f"<html><body{_KEEP}>{around[0]}{self.plain()}{around[1]}</body></html>"
        whole = around[0] + self.article() + around[1]
        if r.random() < 0.3:
            whole = self.element(r.choice(_WRAPPERS), whole)
        return f"<html><body>{whole}</body></html>"


def labels(page: Page) -> np.ndarray:
    """Share of main text among the characters of each node's subtree (NaN without text)."""
    n = len(page.tag)
    state = np.zeros(n, bool)
    good, chars = np.zeros(n), np.zeros(n)
    for k in range(n):
        mark = page.attributes[k]
        up = page.parent[k]
        state[k] = "zkeep" in mark or ("zdrop" not in mark and up >= 0 and state[up])
        if page.tag[k] == "#text":
            chars[k] = len(page.text[k])
            good[k] = chars[k] * state[k]
    for k in range(n - 1, 0, -1):
        chars[page.parent[k]] += chars[k]
        good[page.parent[k]] += good[k]
    with np.errstate(invalid="ignore"):
        return good / chars


@dataclass
class Extractor:
    """The two ensembles: some main text below the node, and nothing else below it."""

    some: Gbt
    only: Gbt

    @classmethod
    def fit(cls, sentences: list[str], n_pages: int = 800, seed: int = 11, params: GbtParams = GbtParams()) -> Extractor:
        layouts = _Layouts(sentences or ["x"], seed)
        pages = [parse(layouts.page()) for _ in range(n_pages)]
        share = np.concatenate([labels(p) for p in pages])
        x = np.concatenate([features(p) for p in pages])
        known = ~np.isnan(share)
        x, share = x[known], share[known]
        return cls(Gbt.fit(x, (share > 0).astype(float), params), Gbt.fit(x, (share == 1).astype(float), params))

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        x = np.concatenate([features(p) for p in pages])
        some, only = self.some.probability(x), self.only.probability(x)
        out, first = [], 0
        for p in pages:
            last = first + len(p.tag)
            out.append("\n".join(p.text[k] for k in decode(p, some[first:last], only[first:last])))
            first = last
        return out


def decode(page: Page, some: np.ndarray, only: np.ndarray) -> list[int]:
    """Text runs of the most likely labelling without contradictions, in page order."""
    n = len(page.tag)
    low = 1e-6
    only = np.minimum(only, some)
    keep = np.log(np.clip(only, low, 1))
    drop = np.log(np.clip(1 - some, low, 1))
    mixed = np.log(np.clip(some - only, low, 1))
    has_text = np.array([t == "#text" for t in page.tag])
    leaf = has_text.copy()
    choice = np.zeros(n)
    for k in range(n - 1, 0, -1):  # children before parents
        if not has_text[k]:
            continue
        up = page.parent[k]
        choice[k] = max(keep[k], drop[k], -np.inf if leaf[k] else mixed[k])
        has_text[up] = True
        keep[up] += keep[k]
        drop[up] += drop[k]
        mixed[up] += choice[k]
    state = np.zeros(n, np.int8)  # 0 mixed, 1 kept, 2 dropped
    found = []
    for k in range(1, n):
        up = page.parent[k]
        if state[up]:
            state[k] = state[up]
        elif not leaf[k] and mixed[k] >= max(keep[k], drop[k]):
            state[k] = 0
        else:
            state[k] = 1 if keep[k] >= drop[k] else 2
        if leaf[k] and state[k] == 1:
            found.append(k)
    return found


# -- Spark -------------------------------------------------------------------------------

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def train(pages: DataFrame, max_pages: int = 200, max_sentences: int = 20_000) -> Extractor:
    """Fit on layouts of sentences of the ``max_pages`` different pages with the smallest hashes, at
    most ``max_sentences`` of them, evenly spread over their order."""
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("h"))
    # numbers only: no page moves before the cut is known
    lowest = hashed.select("h").distinct().orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]

    @F.pandas_udf("array<string>")
    def sentences_of(sources: pd.Series) -> pd.Series:
        return pd.Series([sorted({x for t in parse(s).text for x in _SENTENCE.split(t) if x}) for s in sources], dtype=object)

    if lowest is None:
        return Extractor.fit([])
    chosen = hashed.where(F.col("h") <= lowest).groupBy("h").agg(F.any_value("html").alias("html"))
    rows = chosen.select(sentences_of("html").alias("s")).collect()  # max_pages pages' sentences
    sentences = sorted({x for r in rows for x in r["s"]})
    return Extractor.fit(sentences[:: max(1, len(sentences) // max_sentences)])


def _slices(sources: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """Pages in order, in lists of about so many characters."""
    held, size = [], 0
    for s in sources:
        held.append(s)
        size += len(s or "") + 100
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def extract(pages: DataFrame, model: Extractor, slice_chars: int = 1 << 20) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text."""
    trees = [(m.base, m.feature, m.cut, m.leaf) for m in (model.some, model.only)]
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # size fixed by trees and depth

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = Extractor(*[Gbt(*t) for t in shared.value])
        for sources in batches:
            found: list[str] = []
            for part in _slices(sources.tolist(), slice_chars):  # a bounded number of trees in memory at a time
                found += fitted.extract(part)
            yield pd.Series(found, dtype=object)

    return pages.select("page_id", "url", of(F.col("html")).alias("text"))
