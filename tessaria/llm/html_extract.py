"""HTML extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

A tolerant parser makes a tree of each page. Every block node gets features: its
kind, attribute tokens, depth, text, link and markup density of its subtree,
statistics of its siblings, and the kinds of its ancestors. Boosted trees give
the odds that a node belongs to the main text or holds it; decoding then picks
the likeliest labelling in which nothing is kept below a dropped node. The trees
are trained once per process on pages that :func:`made_page` makes with known labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessaria.llm.common import small_batches

# Fixed values of HTML: elements by how they are parsed and laid out.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Their content is never text.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "textarea", "select", "button", "option", "datalist"}
#: Their content is not parsed: it runs to their own end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "option": {"select"}}

#: Kinds of elements, and tokens of class, id and role by what they tell; each is a feature.
KINDS = {
    "article": {"article", "main"}, "nav": {"nav", "menu"}, "header": {"header"}, "footer": {"footer"}, "aside": {"aside"}, "form": {"form", "fieldset", "dialog"},
    "p": {"p", "blockquote", "pre"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"}, "list": {"ul", "ol", "dl"}, "item": {"li", "dt", "dd"},
    "box": {"div", "section", "center"}, "table": {"table", "tbody", "thead", "tr", "td", "th"}, "page": {"html", "body", "#root"}, "figure": {"figure", "figcaption"}, "hidden": HIDDEN,
}
TOKENS = {
    "text": {"article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page", "articlebody", "maincontent"},
    "nav": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"},
    "chrome": {"header", "footer", "masthead", "banner", "logo", "copyright", "topbar", "bottom", "contentinfo", "colophon", "legal"},
    "side": {"sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "complementary", "rail", "more", "tags", "archive"},
    "ad": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "promoted", "commercial", "adsbygoogle", "adbox"},
    "notice": {"cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "alert", "gdpr", "newsletter", "subscribe", "signup", "paywall", "toast", "warning"},
    "comment": {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "commentlist", "reviews"},
    "form": {"form", "login", "search", "searchbox", "register", "contact", "input", "poll"},
    "share": {"share", "social", "sharing", "follow", "byline", "author", "meta", "print", "buttons", "tools"},
}
KIND_NAMES, TOKEN_NAMES = list(KINDS), list(TOKENS)
KIND_OF = {t: k for k, (_, ts) in enumerate(KINDS.items()) for t in ts}
TOKEN_OF: dict[str, list[int]] = {}
for _k, _ts in enumerate(TOKENS.values()):
    for _t in _ts:
        TOKEN_OF.setdefault(_t, []).append(_k)
OTHER = len(KINDS)

_MARKUP = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(?:[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?)")
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Attributes by which an element and all below it is not shown.
_UNSEEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)(?!\s*=\s*[\"']?until-found)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)


class Tree:
    """Block nodes in page order: kind, parent, depth, tokens, whether unseen; texts and breaks in page order. An unseen inline element is a node too."""

    __slots__ = ("kind", "parent", "depth", "tokens", "unseen", "inner", "events")

    def __init__(self):
        self.kind, self.parent, self.depth, self.tokens, self.unseen = [KIND_OF["#root"]], [-1], [0], [()], [False]
        self.inner = [0]  # inline elements directly below, links apart
        self.events: list[tuple[int, str | None, bool]] = []  # (node, text or None for a break, within a link)

    def add(self, kind: int, parent: int, attributes: str | None) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(attribute_tokens(attributes) if attributes and "=" in attributes else ())
        self.unseen.append(self.unseen[parent] or kind == KIND_OF["script"] or bool(attributes and _UNSEEN.search(attributes)))
        self.inner.append(0)
        return len(self.kind) - 1


@lru_cache(4096)
def attribute_tokens(raw: str) -> tuple[int, ...]:
    found: set[int] = set()
    for m in _ATTRIBUTE.finditer(raw):
        value = m[1] or m[2] or m[3] or ""
        for t in _TOKEN.findall(value) + _TOKEN.findall(_CAMEL.sub(" ", value)):
            found.update(TOKEN_OF.get(t.lower(), ()))
    return tuple(sorted(found))


class Open:
    """The open elements, with the places of each name, so that any can be found without a walk."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = [("#root", 0, 0)]  # (element, its block node, place of the nearest element that is no inline one)
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, name: str, node: int, inline: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, node, self.stack[-1][2] if inline else at))
        self.places[name].append(at)

    def close(self, cut: int) -> None:
        for name, _, _ in reversed(self.stack[cut:]):
            self.places[name].pop()
        del self.stack[cut:]

    def last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def first_after(self, names: set[str], place: int) -> int:
        """The outermost of the names above a place; the top where there is none."""
        found = [ps[k] for n in names if (ps := self.places[n]) and (k := bisect_right(ps, place)) < len(ps)]
        return min(found, default=len(self.stack))


def parse(html: str) -> Tree:
    """Never fails: stray end tags are ignored, open elements close where HTML closes them or at the end."""
    tree, open_ = Tree(), Open()
    stack, links = open_.stack, open_.places["a"]
    events, at, n = tree.events, 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            events.append((stack[-1][1], html[at:stop], bool(links)))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if open_.places[name]:
                cut = open_.places[name][-1]
                if name not in INLINE:
                    events.append((stack[cut - 1][1], None, False))
                open_.close(cut)
            continue
        if name in VOID:
            if name == "br":
                events.append((stack[-1][1], " ", bool(links)))
            elif name == "hr":
                events.append((stack[-1][1], None, False))
            continue
        if name in INLINE:
            node = stack[-1][1]
            if m[3] and _UNSEEN.search(m[3]):
                node = tree.add(OTHER, node, m[3])
            elif name != "a":
                tree.inner[node] += 1
            open_.push(name, node, True)
        else:
            cut, top = len(stack), stack[-1][2]
            if name in CLOSES_P:
                if stack[top][0] == "p":
                    cut = top
            elif name in SIBLINGS:
                cut = open_.first_after(SIBLINGS[name], open_.last(SCOPES[name]))
            elif name == "body" and stack[-1][0] == "head":
                cut = len(stack) - 1
            if cut < len(stack):
                open_.close(cut)
            node = tree.add(KIND_OF.get(name, OTHER), stack[-1][1], m[3])
            events.append((node, None, False))
            if not (m[3] or "").rstrip().endswith("/") or name not in {"svg", "path", "use"}:
                open_.push(name, node, False)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else n  # what an unclosed one holds is no text
    return tree


def features(tree: Tree) -> np.ndarray:
    """A row of features per block node."""
    n = len(tree.kind)
    kind, parent, depth = np.array(tree.kind), np.array(tree.parent), np.array(tree.depth, float)
    chars, linked, wordy, stops = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, link in tree.events:
        if text is not None and not text.isspace():
            c = len(text)
            chars[node] += c
            if link:
                linked[node] += c
            wordy[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",") + text.count("،") + text.count("。")
    hidden = np.array(tree.unseen)  # hidden text counts for nothing
    for a in (chars, linked, wordy, stops):
        a[hidden] = 0
    own = chars.copy()
    size, blocks, paras, marks = np.ones(n), np.zeros(n), (kind == KIND_OF["p"]).astype(float), np.array(tree.inner, float)
    for k in range(n - 1, 0, -1):  # children before parents
        p = parent[k]
        size[p] += size[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        wordy[p] += wordy[k]
        stops[p] += stops[k]
        paras[p] += paras[k]
        marks[p] += marks[k]
        blocks[p] += 1
    up = np.maximum(parent, 0)
    before = np.concatenate([[0.0], np.cumsum(own)[:-1]])  # text ahead of a node, in page order
    total = max(1.0, chars[0])
    order = np.zeros(n)  # place among siblings
    seen = np.zeros(n)
    for k in range(1, n):
        order[k] = seen[parent[k]]
        seen[parent[k]] += 1
    onehot = np.zeros((n, len(KINDS) + 1))
    onehot[np.arange(n), kind] = 1
    tok = np.zeros((n, len(TOKENS)))
    for k, ts in enumerate(tree.tokens):
        for t in ts:
            tok[k, t] = 1
    anc_kind, anc_tok = onehot.copy(), tok.copy()
    anc_kind[0] = anc_tok[0] = 0
    for k in range(1, n):
        p = parent[k]
        anc_kind[k] = np.maximum(anc_kind[p], onehot[p])
        anc_tok[k] = np.maximum(anc_tok[p], tok[p])
    inside = tok.copy()  # tokens below
    for k in range(n - 1, 0, -1):
        inside[parent[k]] = np.maximum(inside[parent[k]], inside[k])
    brothers = np.maximum(1, blocks[up])
    rest = np.column_stack([
        depth, np.log1p(chars), chars / total, linked / np.maximum(1, chars), chars / size, stops / np.maximum(1, wordy), np.log1p(wordy), paras, marks / size,
        blocks, brothers, order / brothers, np.log1p((chars[up] - chars) / brothers), chars / np.maximum(1, chars[up]), before / total, np.log1p(own),
        tok.sum(axis=1), anc_tok.sum(axis=1), inside.sum(axis=1),
    ])
    return np.hstack([onehot, anc_kind, tok, anc_tok, inside, rest])


class Forest:
    """Boosted regression trees on binned features, complete to a fixed depth, with the logistic loss."""

    DEPTH, BINS = 4, 32

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 90, rate: float = 0.25, least: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.BINS + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.bins(x)
        share = y.mean()
        self.start, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.DEPTH) - 1, np.int64), np.full((1 << self.DEPTH) - 1, 255, np.int64)
            for level in range(self.DEPTH):
                wide, first = 1 << level, (1 << level) - 1
                gain, best = np.full(wide, 1e-6), {}
                for f in range(b.shape[1]):
                    key = node * 64 + b[:, f]
                    gs = np.bincount(key, g, wide * 64).reshape(wide, 64).cumsum(1)
                    hs = np.bincount(key, h, wide * 64).reshape(wide, 64).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    won = gs**2 / (hs + least) + (gt - gs) ** 2 / (ht - hs + least) - gt**2 / (ht + least)
                    top = won.argmax(1)
                    for k in np.flatnonzero(won[np.arange(wide), top] > gain):
                        gain[k], best[k] = won[k, top[k]], (f, top[k])
                for k, (f, c) in best.items():
                    feature[first + k], cut[first + k] = f, c
                at = first + node
                node = 2 * node + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = rate * np.bincount(node, g, 1 << self.DEPTH) / (np.bincount(node, h, 1 << self.DEPTH) + least)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)]).astype(np.uint8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            score += leaf[node]
        return score


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels of the nodes in which a dropped node's descendants are all dropped."""
    n = len(parent)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for k in range(n - 1, 0, -1):
        keep[parent[k]] += max(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[parent[k]] and keep[k] > drop[k]
    return out


def block_texts(tree: Tree, kept: np.ndarray) -> list[str]:
    """The kept nodes' texts, a string per block, in page order; nothing that is unseen. Text outside of any element is the root's, which is kept."""
    out: list[str] = []
    part: list[str] = []

    def close() -> None:
        if part and (text := " ".join(unescape("".join(part)).split())):
            out.append(text)
        part.clear()

    for node, text, _ in tree.events:
        if text is None:
            close()
        elif kept[node] and not tree.unseen[node]:
            part.append(text)
    close()
    return out


# --- pages with known labels ---------------------------------------------------------------------------------------------


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of one of many layouts, and the label of each block element in page order."""
    out, labels = [], []

    def pick(*xs):
        return xs[int(rng.integers(len(xs)))]

    def chance(p: float) -> bool:
        return rng.random() < p

    def sentence(most: int = 25) -> str:
        n = int(rng.integers(1, most))
        ws = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) for _ in range(n)]
        return " ".join(ws).capitalize() + pick(".", ".", ".", "", "!", ":", " &amp; x")

    def attrs(*tokens: str) -> str:
        if not tokens or tokens == ("",):
            return ""
        t = pick(*tokens)
        return pick(f' class="{t}"', f' class="{t}"', f' id="{t}"', f' class="c{int(rng.integers(90))} {t}"', f" class='x-{t}'")

    def el(name: str, label: int, attr: str = "", inner=None, close: bool = True) -> None:
        out.append(f"<{name}{attr}>")
        labels.append(label)
        if callable(inner):
            inner()
        elif inner:
            out.append(inner)
        if close:
            out.append(f"</{name}>")

    def links(label: int, n: int) -> None:
        def items():
            for _ in range(n):
                el("li", label, "", f'<a href="/{sentence(2)}">{sentence(3)}</a>', chance(0.8))

        el("ul", label, "", items)

    plain = chance(0.25)  # a page that has divs for paragraphs, and few classes
    para = "div" if plain else "p"

    def paras(label: int, n: int) -> None:
        for _ in range(n):
            body = " ".join(sentence(30) for _ in range(int(rng.integers(1, 6))))
            if chance(0.15):
                body = f"<b>{body}<br>"
            elif chance(0.2):
                body = f'{sentence()} <a href="#">{sentence(4)}</a> <em>{body}</em>'
            el(para, label, "", body, para == "div" or chance(0.85) and "<b>" not in body)

    def nav():
        if chance(0.7):
            el("nav", 0, pick("", attrs("menu", "main", "nav")), lambda: links(0, int(rng.integers(2, 9))))
        else:
            el("div", 0, attrs("menu", "navbar", "nav", "breadcrumbs", "pagination"), lambda: links(0, int(rng.integers(2, 9))))

    def header():
        def inner():
            el(pick("h1", "h2", "div", "p"), 0, "", sentence(6))
            if chance(0.5):
                nav()

        el("header", 0, pick("", attrs("masthead", "header")), inner) if chance(0.6) else el("div", 0, attrs("header", "topbar", "masthead", "banner", "logo"), inner)

    def footer():
        body = lambda: (el("p", 0, "", sentence()), links(0, 3) if chance(0.4) else None)
        what = pick(lambda: out.append("&copy; " + sentence(12)), body)
        el("footer", 0, pick("", attrs("footer")), what) if chance(0.7) else el("div", 0, attrs("footer", "copyright", "legal", "bottom"), what)

    def side():
        def inner():
            if chance(0.6):
                el(pick("h2", "h3", "h4"), 0, "", sentence(4))
            if chance(0.6):
                links(0, int(rng.integers(2, 9)))
            else:
                paras(0, int(rng.integers(1, 3)))

        el("aside", 0, pick("", attrs("sidebar", "related")), inner) if chance(0.5) else el(pick("div", "section"), 0, attrs("sidebar", "widget", "related", "recommended", "trending", "archive", "complementary"), inner)

    def ad():
        what = pick(sentence(), sentence(40), lambda: paras(0, 1), f'<a href="x">{sentence()}</a>')
        el(pick("div", "div", "aside", "section", "p"), 0, attrs("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adbox"), what)

    def notice():
        what = pick(sentence(30), lambda: paras(0, int(rng.integers(1, 3))), f"{sentence()} <a href='#'>ok</a>")
        el(pick("div", "section", "p", "dialog"), 0, attrs("cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "gdpr", "alert"), what)

    def form():
        def inner():
            if chance(0.6):
                el("p", 0, "", sentence())
            out.append(f'<label>{sentence(3)}</label><input type="text">')
            el("button", 0, "", "go")

        el("form", 0, pick("", attrs("search", "login", "contact", "poll")), inner)

    def comments():
        def one():
            el("p", 0, "", sentence(4)) if chance(0.5) else out.append(f"<b>{sentence(3)}</b>")
            paras(0, int(rng.integers(1, 3)))

        def inner():
            if chance(0.6):
                el(pick("h2", "h3"), 0, "", sentence(3))
            for _ in range(int(rng.integers(1, 6))):
                if chance(0.25):
                    el("article", 0, attrs("comment", "reply"), one)
                else:
                    el(pick("div", "li"), 0, pick("", attrs("comment", "reply")), one)

        el(pick("section", "div", "ol", "ul"), 0, attrs("comments", "discussion", "replies", "commentlist", "respond", "reviews"), inner)

    def share():
        el("div", 0, attrs("share", "social", "tools", "follow"), lambda: links(0, 3) if chance(0.5) else out.append(sentence(4)))

    junk = (ad, notice, form, share, side, nav)

    def article():
        if chance(0.25):  # a short one
            if chance(0.5):
                el(pick("h1", "h2"), 1, "", sentence(6))
            for _ in range(int(rng.integers(1, 4))):
                el(para, 1, "", " ".join(sentence(20) for _ in range(int(rng.integers(1, 3)))))
            return
        if chance(0.85):
            el(pick("h1", "h1", "h2"), 1, "", sentence(14))
        for _ in range(int(rng.integers(1, 5))):
            paras(1, int(rng.integers(0, 7)))
            if chance(0.25):
                el(pick("h2", "h3"), 1, "", sentence(8))
            if chance(0.15):
                def items():
                    for _ in range(int(rng.integers(1, 6))):
                        el("li", 1, "", sentence(), chance(0.8))

                el(pick("ul", "ol"), 1, "", items)
            if chance(0.08):
                el("blockquote", 1, "", lambda: paras(1, 1))
            if chance(0.05):
                el("pre", 1, "", sentence(40))
            if chance(0.06):
                def rows():
                    for _ in range(3):
                        el("tr", 1, "", lambda: [el("td", 1, "", sentence(5)) for _ in range(2)])

                el("table", 1, "", rows)
            if chance(0.12):
                pick(*junk[:4])()
            if chance(0.1):
                el("div", 1, "", sentence(40))
        paras(1, 1)
        if chance(0.12):
            comments()

    def cells():
        """A table that lays out the page: menus and boxes in some cells, the article in another."""
        def row():
            if chance(0.5):
                el("td", 0, "", lambda: links(0, int(rng.integers(2, 9))))
            el("td", 1, "", article)
            if chance(0.4):
                el("td", 0, "", pick(ad, side, form))

        el("table", 1, "", lambda: el("tr", 1, "", row))

    def nested(depth: int) -> None:
        """The article in elements that say nothing of it."""
        el(pick("div", "div", "section"), 1, pick("", "", f' class="c{int(rng.integers(90))}"', f' id="x{int(rng.integers(90))}"'), lambda: nested(depth - 1) if depth else article())

    def middle():
        if chance(0.7 if plain else 0.12):
            cells() if chance(0.25) else nested(int(rng.integers(0, 3)))
        elif chance(0.65):
            el("article", 1, pick("", attrs("post", "entry", "story")), article)
        else:
            el(pick("div", "section", "main", "td"), 1, attrs("content", "article", "main", "post", "entry", "story", "text"), article)
        if chance(0.3):
            comments()

    def bare():
        """Text without elements of its own, cut by line breaks or not at all."""
        for _ in range(int(rng.integers(1, 9))):
            out.append(" ".join(sentence(30) for _ in range(int(rng.integers(1, 6)))) + pick("<br>", "<br><br>", " ", "<hr>"))
            if chance(0.2):
                el(pick("h1", "h2", "h3"), 1, "", sentence(6))

    def body():
        for part, p in ((notice, 0.25), (header, 0.5), (nav, 0.6), (ad, 0.5), (side, 0.3), (form, 0.2)):
            if chance(p):
                if chance(0.3):
                    out.append(f"<!-- {sentence(5)} <p> -->")
                part()
        if chance(0.14):
            pick(bare, article)()  # text, or headings and paragraphs, that stand in the page itself
            for part, p in ((nav, 0.3), (footer, 0.5), (ad, 0.2)):
                if chance(p):
                    part()
            return
        wrap = pick(None, None, "main", "div")
        el(wrap, 1, attrs("wrapper", "container", "page", "") if wrap == "div" else "", middle) if wrap else middle()
        for part, p in ((side, 0.3), (ad, 0.3), (share, 0.2), (comments, 0.1), (form, 0.15), (notice, 0.15), (nav, 0.15), (footer, 0.8)):
            if chance(p):
                part()

    def head():
        el("title", 0, "", sentence(9))
        if chance(0.6):
            el("style", 0, "", "p{margin:0}")
        if chance(0.6):
            el("script", 0, "", 'var t="</p>";')

    if chance(0.1):  # a fragment
        pick(body, article, middle)()
        return "".join(out), labels
    out.append("<!DOCTYPE html>")
    el("html", 1, "", lambda: (el("head", 0, "", head), el("body", 1, "", body)), chance(0.9))
    return "".join(out), labels


TRAINING_PAGES = 1600


@lru_cache(1)
def model(pages: int = TRAINING_PAGES) -> Forest:
    """The forest, trained on made pages; the same in every process."""
    rng, xs, ys = np.random.default_rng(7), [], []
    for _ in range(pages):
        html, labels = made_page(rng)
        tree = parse(html)
        assert len(tree.kind) == len(labels) + 1, "a made page parses into its own elements"
        xs.append(features(tree)[1:])
        ys.append(labels)
    return Forest(np.vstack(xs), np.concatenate(ys).astype(float))


def extract_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """The main text of each page, blocks joined by a newline; empty for null and for pages without any."""
    trees = [parse(p) if p else None for p in pages]
    full = [t for t in trees if t is not None]
    if not full:
        return [""] * len(pages)
    xs = [features(t) for t in full]
    odds, at, out = forest.odds(np.vstack(xs)), 0, []
    for t in trees:
        if t is None:
            out.append("")
            continue
        n = len(t.kind)
        out.append("\n".join(block_texts(t, decode(t.parent, odds[at : at + n]))))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give an empty text; a page
    without any element is its text. Elements that are not shown (by their kind, or by
    hidden, aria-hidden or style) are left out with all they hold. Unclosed and stray tags, cut-off pages and pages of any length are parsed to their end.
    Repeated rows are extracted one by one, other columns are ignored, an empty
    table gives an empty result.
    """
    shared = small_batches(pages).sparkSession.sparkContext.broadcast(model())  # some 100 kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = extract_texts(b.column(2).to_pylist(), forest)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
