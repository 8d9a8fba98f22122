"""HTML extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is read into a tree of elements (tolerant of unclosed and stray tags).
Each element gets features of its subtree (text, link and tag densities), its
own text, its tag, its attribute tokens, its depth, its siblings and its parent.
Boosted trees give the probability that an element belongs to the main text.

Decoding chooses one of three states for every element: *around* (its own text is
dropped, main text may lie below), *main* (its own text is kept) or *out* (nothing
below is kept).  Around may lead to any state, main to main or out, out only to
out; the choice with the largest sum of log-probabilities is found by dynamic
programming from the leaves up, so no element is kept below one that is out.

The trees are fitted here, on generated pages whose element labels are known from
their making (``TRAIN_PAGES`` of many layouts, from a fixed seed); the model is
some hundred kilobytes and goes to the executors in the task.

Reading is linear in the length of a page, whatever it holds: a quote that is never closed is an ordinary
character, and what begins a tag without an end is text.  Features are made for at most ``ELEMENTS`` elements at once.

Defined results: a null, empty or text-free html gives an empty text; scripts,
styles, comments and markup never count; repeated rows stay repeated; other
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html as _html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, read, small

TRAIN_PAGES, SEED = 700, 7
TREES, DEPTH, RATE, HIST = 60, 4, 0.2, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul head".split()
)
#: A start tag of the first kind ends an open element of the second.
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"body", "html", "head"}} | {
    "li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("table ul ol dl div section article main body td th aside nav header footer form".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TAGS = "p div article main section nav header footer aside ul ol li a h1 h2 h3 form button label table td tr span b blockquote pre figure body".split()
#: What attribute tokens (class, id, role) speak of.
GROUPS = (
    frozenset("ad ads advert advertisement sponsor sponsored promo banner adsense".split()),
    frozenset("nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination".split()),
    frozenset("footer foot copyright legal colophon".split()),
    frozenset("header masthead topbar logo branding".split()),
    frozenset("sidebar side aside widget rail related recommended trending".split()),
    frozenset("comment comments reply replies disqus discussion respond".split()),
    frozenset("cookie consent notice alert gdpr modal popup overlay message".split()),
    frozenset("form subscribe newsletter signup login search share social".split()),
    frozenset("article content post entry story main body text prose".split()),
)


class _Tags:
    """The tags of a source, each found once: every character is looked at a bounded number of times.

    A quoted value may hold ``>``; a quote that is never closed is an ordinary character.  If a tag has no end that
    way, quotes count for nothing from there on.  What begins a tag behind the last ``>`` is text.
    """

    __slots__ = ("source", "last", "shut", "quotes")

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.shut = {q: source.rfind(q) for q in "\"'"}  # behind these no value can be closed
        self.quotes = True

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``."""
        source, i = self.source, at
        while self.quotes:
            m = _STOP.search(source, i)
            if m is None:
                self.quotes = False
                break
            q, i = m.group(), m.end()
            if q == ">":
                return i - 1
            if i - 1 < self.shut[q]:
                i = source.index(q, i) + 1
        return source.index(">", at)

    def __iter__(self):
        """(start, end, closing, name, attributes); name is None for comments and declarations.  ``send`` gives a place to go on from."""
        source, at = self.source, 0
        while True:
            at = source.find("<", at)
            if at < 0:
                return
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = len(source) if end < 0 else end + 3
                found = (at, end, "", None, "")
            elif at > self.last:
                at += 1  # of what follows only a comment can count
                at = source.find("<!--", at)
                if at < 0:
                    return
                continue
            elif source.startswith(("<!", "<?"), at):
                end = source.index(">", at) + 1
                found = (at, end, "", None, "")
            else:
                m = _NAME.match(source, at)
                if m is None:
                    at += 1
                    continue
                if m.end() > self.last:
                    at += 1
                    continue
                stop = self._end(m.end())
                end = stop + 1
                found = (at, end, m.group(1), m.group(2).lower(), source[m.end() : stop])
            to = yield found
            at = end if to is None else to


class Page:
    """Elements in page order: ``parent``, ``tag``, ``attrs``, and ``items`` (own text or child index, in order)."""

    __slots__ = ("parent", "tag", "attrs", "items")

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs, self.items = [-1], ["#root"], [""], [[]]
        parent, tag_of, attrs, items = self.parent, self.tag, self.attrs, self.items
        stack, n = [0], len(source)
        open_at: dict[str, list[int]] = {}  # by tag, the places in the stack of its open elements
        scopes = [0]  # the places of open elements of SCOPE

        def shut(i: int) -> None:
            while len(stack) > i:
                t = tag_of[stack.pop()]
                open_at[t].pop()
                if t in SCOPE:
                    scopes.pop()

        at, ended = 0, {}  # ended: raw tags without a closing tag behind a place
        tags = iter(_Tags(source))
        found = next(tags, None)
        while found is not None:
            start, end, closing, name, said = found
            if start > at:
                items[stack[-1]].append(source[at:start])
            at, to = end, None
            if name is not None and closing:
                if open_at.get(name):
                    shut(open_at[name][-1])
            elif name is not None:
                ends = ENDS.get(name)
                if ends:
                    i = max((open_at[t][-1] for t in ends if open_at.get(t)), default=0)
                    if i and i >= scopes[-1]:
                        shut(i)
                k = len(parent)
                parent.append(stack[-1])
                tag_of.append(name)
                attrs.append(said)
                items[stack[-1]].append(k)
                items.append([])
                if name in RAW:
                    close = None if name in ended else _close_of(name).search(source, at)
                    if close is None:
                        ended[name] = True
                    at = to = close.end() if close else n
                elif name not in VOID and not said.endswith("/"):
                    open_at.setdefault(name, []).append(len(stack))
                    if name in SCOPE:
                        scopes.append(len(stack))
                    stack.append(k)
            try:
                found = tags.send(to)
            except StopIteration:
                break
        if at < n:
            items[stack[-1]].append(source[at:])


@functools.cache
def _close_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*+>", re.I)


_LONG_NUMBER = re.compile(r"&#0*+([0-9]++)|&#[xX]0*+([0-9a-fA-F]++)")


def _short_number(m: re.Match) -> str:
    digits = m.group(1) or m.group(2)
    return m.group() if len(m.group()) < 10 else ("&#x" if m.group(2) else "&#") + (digits if len(digits) < 8 else "110000" if m.group(2) else "1114112")


def unescape(text: str) -> str:
    """Character references decoded, those of numbers with very many digits too (beyond the last code point: the replacement character)."""
    return _html.unescape(_LONG_NUMBER.sub(_short_number, text)) if "&" in text else text


@functools.lru_cache(maxsize=4096)
def _attr_groups(attrs: str) -> int:
    """The groups that the attribute tokens name, one bit each."""
    words: set[str] = set()
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in _WORDS.findall(a or b or c))
    return sum(1 << i for i, g in enumerate(GROUPS) if not words.isdisjoint(g))


_GROUP_BITS = (np.arange(1 << len(GROUPS))[:, None] >> np.arange(len(GROUPS)) & 1).astype(np.float32)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_OWN = len(GROUPS) + 12
N_FEATURES = len(TAGS) + 2 * len(GROUPS) + N_OWN + 6


class Measures:
    """What the features of a page's elements are made of, one number for each element and measure."""

    def __init__(self, page: Page):
        n, parent, tag = len(page.parent), page.parent, page.tag
        own, words, stops, children, order = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        alike = [0] * n  # how many of its siblings, itself included, have its tag
        for i in range(n):
            count: dict[str, int] = {}
            k = 0
            for x in page.items[i]:
                if x.__class__ is int:
                    count[tag[x]] = count.get(tag[x], 0) + 1
                    order[x] = k
                    k += 1
                else:
                    s = x.strip()
                    if s:
                        own[i] += len(s)
                        words[i] += s.count(" ") + 1
                        stops[i] += s.count(".") + s.count(",")
            children[i] = k
            for x in page.items[i]:
                if x.__class__ is int:
                    alike[x] = count[tag[x]]
        text, word, stop, tags, link, paragraphs = own[:], words[:], stops[:], [1] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            word[p] += word[i]
            stop[p] += stop[i]
            tags[p] += tags[i]
            link[p] += text[i] if tag[i] == "a" else link[i]
            paragraphs[p] += paragraphs[i] + (tag[i] == "p")
        depth, group, above = [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            said = page.attrs[i]
            group[i] = _attr_groups(said) if "=" in said and len(said) < 1000 else _attr_groups.__wrapped__(said) if "=" in said else 0
            above[i] = group[p] | above[p]
        array = lambda x: np.array(x, np.int64)
        self.n, self.parent, self.kind = n, array(parent), array([_TAG_AT.get(t, -1) for t in tag])
        self.own, self.children, self.order, self.alike = array(own), array(children), array(order), array(alike)
        self.text, self.word, self.stop, self.tags, self.link, self.paragraphs = map(array, (text, word, stop, tags, link, paragraphs))
        self.depth, self.group, self.above = array(depth), array(group), array(above)

    def features(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """One row of features for each element from ``lo`` to ``hi``."""
        hi = self.n if hi is None else hi
        at = np.arange(lo, hi)
        up = np.maximum(self.parent[lo:hi], 0)
        out = np.zeros((hi - lo, N_FEATURES), np.float32)
        kind, inner = self.kind[lo:hi], at > 0
        known = np.flatnonzero(kind >= 0)
        out[known, kind[known]] = 1
        t0, t1, t2 = len(TAGS), len(TAGS) + len(GROUPS), len(TAGS) + 2 * len(GROUPS)
        out[:, t0:t1] = _GROUP_BITS[self.group[lo:hi]]
        out[:, t1:t2] = _GROUP_BITS[self.above[lo:hi]]
        text, tags, word = self.text[lo:hi], self.tags[lo:hi], self.word[lo:hi]
        siblings = np.where(inner, self.children[up], 1)
        own = (
            self.depth[lo:hi], np.log1p(text), np.log1p(self.own[lo:hi]), self.link[lo:hi] / (text + 1), text / tags, self.stop[lo:hi] / (word + 1), word,
            text / (self.text[0] + 1), self.children[lo:hi], siblings, self.order[lo:hi] / siblings, np.where(inner, self.alike[lo:hi] / siblings, 1),
            self.paragraphs[lo:hi],
        )
        parents = (self.kind[up], self.link[up] / (self.text[up] + 1), self.text[up] / self.tags[up], self.paragraphs[up], text / (self.text[up] + 1))
        for j, column in enumerate((*own, *[np.where(inner, column, 0) for column in parents])):
            out[:, t2 + j] = column
        return out


def features(page: Page) -> np.ndarray:
    return Measures(page).features()


# ---- boosted trees -----------------------------------------------------------


class Forest:
    """Boosted trees of fixed depth on binned features: arrays of (feature, cut) by heap position, and leaf values."""

    def __init__(self, edges, feature, cut, leaf, base):
        self.edges, self.feature, self.cut, self.leaf, self.base = edges, feature, cut, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Forest:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, HIST + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        base = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(n, base)
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        feature, cut, leaf = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
        flat = binned + np.arange(d) * HIST
        for t in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 8:
                        continue
                    at = flat[rows].ravel()
                    gs = np.bincount(at, np.repeat(g[rows], d), d * HIST).reshape(d, HIST).cumsum(1)
                    hs = np.bincount(at, np.repeat(h[rows], d), d * HIST).reshape(d, HIST).cumsum(1)
                    gt, ht = g[rows].sum(), h[rows].sum()
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1)
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if b < len(edges[j]) and gain[j, b] > gt**2 / (ht + 1) + 1e-6:
                        s = 2**level - 1 + k
                        feature[t, s], cut[t, s] = j, edges[j][b]
                s = 2**level - 1 + node
                node = 2 * node + (x[np.arange(n), feature[t, s]] > cut[t, s])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            leaf[t] = RATE * gs / (hs + 1)
            z += leaf[t][node]
        return cls(None, feature, cut, leaf, base)

    def logit(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        z, row = np.full(n, self.base), np.arange(n)
        for t in range(len(self.feature)):
            node = np.zeros(n, np.int64)
            for level in range(DEPTH):
                s = 2**level - 1 + node
                node = 2 * node + (x[row, self.feature[t, s]] > self.cut[t, s])
            z += self.leaf[t][node]
        return z


# ---- decoding ----------------------------------------------------------------

AROUND, MAIN, OUT = 0, 1, 2


def decode(page: Page, logit: np.ndarray) -> list[int]:
    """The best consistent states of a page's elements."""
    n = len(page.parent)
    keep = (-np.logaddexp(0, -logit)).tolist()
    drop = (-np.logaddexp(0, logit)).tolist()
    best = [[drop[i], keep[i], drop[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        a, m, o = best[i]
        p = best[page.parent[i]]
        p[0] += max(a, m, o)
        p[1] += max(m, o)
        p[2] += o
    state = [AROUND] * n
    for i in range(1, n):
        a, m, o = best[i]
        above = state[page.parent[i]]
        if above == OUT:
            state[i] = OUT
        elif above == MAIN:
            state[i] = MAIN if m >= o else OUT
        else:
            state[i] = MAIN if m >= a and m >= o else AROUND if a >= o else OUT
    return state


def blocks(page: Page, state: list[int]) -> list[str]:
    """The text of kept elements, block by block in page order; character references decoded, white space folded."""
    out: list[str] = []
    piece: list[str] = []

    def flush():
        if piece:
            s = _SPACE.sub(" ", unescape("".join(piece))).strip()
            if s:
                out.append(s)
            piece.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        i, k = stack.pop()
        items = page.items[i]
        kept = state[i] == MAIN
        while k < len(items):
            x = items[k]
            k += 1
            if x.__class__ is str:
                if kept:
                    piece.append(x)
                continue
            tag = page.tag[x]
            if tag == "br":
                piece.append(" ")
            if tag in BLOCK or (state[x] == MAIN) != kept:
                flush()
            if state[x] != OUT and page.items[x]:
                stack.append((i, k))
                stack.append((x, 0))
                break
        else:
            if page.tag[i] in BLOCK:
                flush()
    flush()
    return out


# ---- generated pages ---------------------------------------------------------


class _Maker:
    """Pages of many layouts; main-text elements carry the attribute ``x-k`` that training removes again."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.letters = "etaoinshrdlucmfwypvbgkqjxzé"

    def word(self):
        r = self.r
        return "".join(r.choice(self.letters[: r.choice((6, 12, 27))]) for _ in range(r.randint(1, 11)))

    def words(self, a, b):
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def prose(self, a=8, b=90):
        r, out, n = self.r, [], self.r.randint(a, b)
        for _ in range(n):
            out.append(self.word() + r.choice(("", "", "", "", "", ",", ".")))
        return (" ".join(out)).capitalize() + r.choice((".", ".", "", "&amp; co."))

    def link(self, a=1, b=3):
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def cls(self, *names):
        r = self.r
        if r.random() < 0.15:
            return ""
        n = r.choice(names)
        n = r.choice((n, n + "-" + self.word()[:4], self.word()[:3] + "-" + n, n.capitalize() + "Box"))
        return f' {r.choice(("class", "class", "id"))}="{n}"'

    def nav(self):
        r = self.r
        items = [self.link() for _ in range(r.randint(2, 12))]
        if r.random() < 0.6:
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        else:
            body = r.choice((" | ", " ", "\n")).join(items)
        t = r.choice(("nav", "nav", "div", "header"))
        return f"<{t}{self.cls('nav', 'menu', 'navbar', 'header') if t == 'div' or r.random() < 0.3 else ''}>{body}</{t}>"

    def header(self):
        t = self.r.choice(("header", "div"))
        return f"<{t}{self.cls('header', 'masthead', 'topbar')}>{self.r.choice(('', f'<h1>{self.words(1, 4)}</h1>'))}{self.words(1, 8)}{self.link()}</{t}>"

    def footer(self):
        t = self.r.choice(("footer", "footer", "div"))
        inner = self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(2, 30)}", f"<p>{self.prose(3, 25)}</p>" + self.link(), self.words(2, 12) + self.link()))
        return f"<{t}{self.cls('footer', 'legal', 'copyright') if t == 'div' or self.r.random() < 0.3 else ''}>{inner}</{t}>"

    def junk(self):
        r = self.r
        kind = r.randrange(6)
        if kind == 0:
            return f"<div{self.cls('ad', 'advert', 'sponsored', 'banner', 'promo') or ' class=ad'}>{r.choice((self.prose(2, 40), self.words(2, 9), f'<p>{self.prose(3, 30)}</p>' + self.link()))}</div>"
        if kind == 1:
            t = r.choice(("aside", "div"))
            inner = "".join(r.choice((f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose(3, 30)}</p>", f"<ul><li>{self.link()}</li><li>{self.link(2, 7)}</li></ul>")) for _ in range(r.randint(1, 5)))
            return f"<{t}{self.cls('sidebar', 'related', 'widget') if t == 'div' or r.random() < 0.4 else ''}>{inner}</{t}>"
        if kind == 2:
            return f"<div{self.cls('cookie', 'notice', 'consent', 'alert')  or ' class=notice'}>{r.choice((f'<p>{self.prose(4, 35)}</p>', self.prose(4, 35)))}<button>{self.word()}</button></div>"
        if kind == 3:
            return f"<form{self.cls('subscribe', 'newsletter', 'search')}><label>{self.words(1, 5)}</label><input type='text'><p>{self.prose(3, 20)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == 4:
            c = "".join(f"<div{self.cls('comment', 'reply')}><b>{self.word()}</b><p>{self.prose(3, 60)}</p></div>" for _ in range(r.randint(1, 7)))
            t = r.choice(("section", "div", "ol"))
            return f"<{t} {r.choice(('class', 'id'))}='comments'><h3>{self.words(1, 3)}</h3>{c}</{t}>"
        return f"<div{self.cls('share', 'social', 'breadcrumb', 'pagination')}>{self.link()}{self.link()}{self.words(0, 3)}</div>"

    def main(self):
        r = self.r
        k = " x-k"
        parts = [f"<h1{k}>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 4, 7, 12))):
            kind = r.random()
            if kind < 0.7:
                p = self.prose(*r.choice(((1, 12), (10, 60), (40, 160))))
                if r.random() < 0.3:
                    p = f"<{'b' + k}>{p}" + r.choice(("</b>", "", "<br>"))
                elif r.random() < 0.2:
                    p += f" <a{k} href='/x'>{self.words(1, 3)}</a> " + self.prose(3, 20)
                parts.append(f"<p{k}>{p}" + r.choice(("</p>", "</p>", "")))
            elif kind < 0.78:
                parts.append(f"<h2{k}>{self.words(1, 8)}</h2>")
            elif kind < 0.84:
                parts.append(f"<ul{k}>" + "".join(f"<li{k}>{self.prose(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote{k}><p{k}>{self.prose(5, 40)}</p></blockquote>")
            elif kind < 0.92:
                parts.append(f"<table{k}><tr{k}><td{k}>{self.words(1, 5)}</td><td{k}>{self.prose(1, 9)}</td></tr></table>")
            elif kind < 0.95:
                parts.append(f"<div{k}>{self.prose(10, 60)}</div>")
            else:
                parts.append(self.junk())
        t = r.choice(("article", "article", "main", "div", "section"))
        c = self.cls("article", "content", "post", "entry", "story", "main") if t in ("div", "section") or r.random() < 0.3 else ""
        body = f"<{t}{k}{c}>{''.join(parts)}</{t}>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = f"<div{self.cls('wrap', 'container', 'page', 'content')}>{body}{self.junk() if r.random() < 0.4 else ''}</div>"
        return body

    def page(self):
        r = self.r
        top = [f(self) for f in (_Maker.nav, _Maker.header) if r.random() < 0.7]
        before = [self.junk() for _ in range(r.choice((0, 1, 1, 2)))]
        after = [self.junk() for _ in range(r.choice((0, 0, 1, 2, 3)))]
        r.shuffle(top)
        body = "".join([*top, *before, self.main(), *after, self.footer() if r.random() < 0.85 else ""])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}</body></html>"


@functools.lru_cache(maxsize=1)
def model() -> Forest:
    maker = _Maker(random.Random(SEED))
    x, y = [], []
    for _ in range(TRAIN_PAGES):
        page = Page(maker.page())
        label = np.array(["x-k" in a for a in page.attrs], float)
        page.attrs = [a.replace("x-k", "") for a in page.attrs]
        x.append(features(page)[1:])
        y.append(label[1:])
    return Forest.fit(np.concatenate(x), np.concatenate(y))


#: Elements whose features are held at once.
ELEMENTS = 32_768


def extract_texts(forest: Forest, sources: Iterable[str]) -> list[str]:
    """The main text of each page; a page with very many elements has its features made in parts."""
    out: list[str] = []
    held: list[tuple[Page, Measures]] = []

    def judge():
        logit = forest.logit(np.concatenate([m.features() for _, m in held]))
        at = 0
        for page, m in held:
            out.append("\n".join(blocks(page, decode(page, logit[at : at + m.n]))))
            at += m.n
        held.clear()

    size = 0
    for source in sources:
        page = Page(source)
        m = Measures(page)
        if held and size + m.n > ELEMENTS:
            judge()
            size = 0
        if m.n > ELEMENTS:
            logit = np.concatenate([forest.logit(m.features(lo, min(lo + ELEMENTS, m.n))) for lo in range(0, m.n, ELEMENTS)])
            out.append("\n".join(blocks(page, decode(page, logit))))
        else:
            held.append((page, m))
            size += m.n
    if held:
        judge()
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep..., text, n_chars of every row."""
    from pyspark.sql import types as T

    bound_batches(pages.sparkSession)
    forest, kept = model(), [pages.schema[c] for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, len(kept)):
            texts = extract_texts(forest, [s or "" for s in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
            )

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, html_col).mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
