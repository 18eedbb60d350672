"""Main text of web pages: boosted trees over DOM nodes, decoded top-down.

1. A tolerant parser builds the block tree of a page (block elements, and
   inline ones that have a class, id or role). Scripts, styles, comments and the like are left out.
2. Each node is described by its tag, depth, subtree densities (text, links, tags,
   headings, controls), attribute tokens of itself and its ancestors, its place and its siblings.
3. Gradient-boosted trees give the probability that a node is part of the article. They
   are trained here, on PAGES generated pages.
4. Decoding picks states for all nodes at once: outside (the article may begin below), main,
   or dropped (nothing below is main). Outside leads to any state, main to main or
   dropped, dropped to dropped only; dynamic programming over the tree maximises node
   probabilities and transition frequencies, so no node contradicts its ancestors.

Text: references decoded, white space runs become one space, blocks are joined by one space.

Scripts, styles, titles, text areas, templates, drawings, frames and lists of choices are left out whole. ``<x />`` is empty. A script,
style or text area without an end tag reaches to the end of the page; of the others, only the start tag (and a list's options) is left out then.
What is in ``noscript``, ``object`` or ``canvas`` is judged by the trees like any other element.

Cases: a null or empty page has the empty text, and so has one without an
article. Unclosed or stray tags are repaired. Pages of any length are read whole.
Repeated rows get the same text. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PAGES = 360
TREES, DEPTH, RATE, STEPS = 48, 4, 0.25, 24

_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*>|</[a-zA-Z][^>]*>|<[a-zA-Z](?:\"[^\"<>]*\"|'[^'<>]*'|[^'\">])*+>|<[a-zA-Z][^>]*>")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Left out with all that is in them: up to the first end tag (in these, tags are text), or up to their own end tag.
_RAW_TEXT = frozenset("script style title textarea".split())
_UNSHOWN = frozenset("template svg iframe select".split())
#: Without an end tag, these reach to the end of the page; the others of both lists are empty.
_TO_THE_END = frozenset("script style textarea".split())
_SELF_CLOSED = re.compile(r"(?:[\s\"']|<[a-zA-Z0-9:-]+)/>$")
_OPTIONS = re.compile(r"(?i)(?:\s*</?(?:option|optgroup)\b[^>]*>[^<]*)*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input button ruby rt rp".split()
)
#: An opening tag ends the open element of these names.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split())
_TAGS = "html body div section article main nav header footer aside form p li ul ol h1 h2 h3 table td blockquote pre figure".split()
#: Attribute tokens by what they hint at.
_LEXICON = {
    "main": "article content main post entry story body text prose page blog news paragraph",
    "menu": "nav menu navbar breadcrumb breadcrumbs pager pagination toc skip tabs navigation",
    "head": "header masthead topbar banner logo brand hero",
    "foot": "footer copyright legal bottom colophon imprint",
    "side": "sidebar aside side widget rail related recommended popular trending tags archive more",
    "ads": "ad ads advert adverts advertisement promo promotion sponsor sponsored dfp affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast newsletter subscribe signup paywall",
    "talk": "comment comments reply replies discussion disqus respond feedback review reviews",
    "share": "share sharing social follow like byline author meta date",
    "form": "form login search input contact captcha register",
}
_GROUPS = list(_LEXICON)
_GROUP_OF = {w: i for i, (_, ws) in enumerate(_LEXICON.items()) for w in ws.split()}


@dataclass
class Page:
    """Block nodes in document order, and the text between tags with the node that it is in."""

    tags: list[str] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    #: (node, text, inside a link); node -1 marks a block's edge.
    texts: list[tuple[int, str, bool]] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    n_tags: list[int] = field(default_factory=list)


def hint_bits(tag_text: str) -> int:
    bits = 0
    for m in _ATTRIBUTE.finditer(tag_text):
        for w in _PIECES.findall(m[1]):
            g = _GROUP_OF.get(w.lower())
            if g is not None:
                bits |= 1 << g
    return bits


class _LeftOut:
    """Where elements that are left out end. Each name is looked up in the source once, however often it occurs."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.ends: dict[str, dict[int, int]] = {}
        self.none_after: set[str] = set()

    def end(self, name: str, start: int, inside: int, closed: bool) -> int:
        if closed:
            return inside
        if name in _UNSHOWN:
            if name not in self.ends:
                self.ends[name] = self._pairs(name)
            found = self.ends[name].get(start)
            if found is None and name == "select":
                return _OPTIONS.match(self.source, inside).end()
            return inside if found is None else found
        m = None if name in self.none_after else re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>").search(self.source, inside)
        if m:
            return m.end()
        self.none_after.add(name)
        return len(self.source) if name in _TO_THE_END else inside

    def _pairs(self, name: str) -> dict[int, int]:
        """Start of a start tag -> end of its end tag, for those that have one."""
        opened, out = [], {}
        for m in re.finditer(rf"(?i)<(/?){name}(?=[\s/>])[^>]*>", self.source):
            if not m[1]:
                if not _SELF_CLOSED.search(m[0]):
                    opened.append(m.start())
            elif opened:
                out[opened.pop()] = m.end()
        return out


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = []  # (name, node that text in it belongs to)
    count: dict[str, int] = {}
    links = 0
    left_out = _LeftOut(source)

    def push(name: str, node: int) -> None:
        stack.append((name, node))
        count[name] = count.get(name, 0) + 1

    def pop_to(name: str) -> None:
        nonlocal links
        while stack:
            top, node = stack.pop()
            count[top] -= 1
            links -= top == "a"
            if top not in _INLINE:
                page.texts.append((-1, "", False))
            if top == name:
                return

    def add_node(tag: str, hints: int) -> int:
        page.tags.append(tag)
        page.hints.append(hints)
        page.parents.append(stack[-1][1] if stack else (0 if page.tags[1:] else -1))
        page.controls.append(0)
        page.n_tags.append(0)
        return len(page.tags) - 1

    add_node("#root", 0)
    at, n, size = 0, 0, len(source)
    here = lambda: stack[-1][1] if stack else 0
    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            page.texts.append((here(), source[at:], links > 0))
            break
        if m.start() > at:
            page.texts.append((here(), source[at : m.start()], links > 0))
        t, at = m[0], m.end()
        if t == "<!--":
            at = end + 3 if (end := source.find("-->", at)) >= 0 else size
            continue
        if t == "<![CDATA[":
            at = end + 3 if (end := source.find("]]>", at)) >= 0 else size
            continue
        if t[1] in "!?":
            continue
        name = _NAME.match(t)[1].lower()
        if t[1] == "/":
            if count.get(name):
                pop_to(name)
            continue
        n += 1
        node = here()
        page.n_tags[node] += 1
        if name in _RAW_TEXT or name in _UNSHOWN:
            page.controls[node] += name in ("textarea", "select")
            at = left_out.end(name, m.start(), at, bool(_SELF_CLOSED.search(t)))
            continue
        if name in ("input", "button"):
            page.controls[node] += 1
        if name in _VOID:
            if name in ("br", "hr"):
                page.texts.append((-1, "", False))
            continue
        if name in _ENDS_P and count.get("p"):
            pop_to("p")
        for other in _ENDS.get(name, ()):
            if count.get(other) and (other == "p" or _nearer(stack, other)):
                pop_to(other)
                break
        hints = hint_bits(t) if "=" in t else 0
        if name in _INLINE and not hints:
            push(name, here())
        else:
            if name not in _INLINE:
                page.texts.append((-1, "", False))
            push(name, add_node(name, hints))
        links += name == "a"
    return page


def _nearer(stack: list[tuple[str, int]], name: str) -> bool:
    """Whether ``name`` is open inside the nearest list or table."""
    for top, _ in reversed(stack):
        if top == name:
            return True
        if top in ("ul", "ol", "dl", "table", "select"):
            return False
    return False


# -- features --------------------------------------------------------------------------

N_FEATURES = len(_TAGS) + 2 * len(_GROUPS) + 24
_TAG_INDEX = {t: i for i, t in enumerate(_TAGS)}
_BOILER_TAGS = frozenset("nav header footer aside form".split())
_SENTENCE = re.compile(r"[.!?;,]")


def describe(page: Page) -> tuple[np.ndarray, list[str]]:
    """Feature rows of the nodes, and the decoded text pieces."""
    n = len(page.tags)
    own, linked, marks, first = [0] * n, [0] * n, [0] * n, [-1] * n
    pieces, seen = [], 0
    for node, raw, in_link in page.texts:
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if node < 0:
            continue
        k = len(text.strip())
        if k:
            own[node] += k
            linked[node] += k if in_link else 0
            marks[node] += len(_SENTENCE.findall(text))
            if first[node] < 0:
                first[node] = seen
            seen += k
    text, link, mark, tags, control = own[:], linked[:], marks[:], page.n_tags[:], page.controls[:]
    paragraphs = [int(t == "p") for t in page.tags]
    heads = [int(t in ("h1", "h2", "h3")) for t in page.tags]
    items = [int(t == "li") for t in page.tags]
    top = [int(t in ("article", "main")) for t in page.tags]
    children, rank_text, nodes, hinted = [0] * n, [0] * n, [1] * n, [0] * n
    depth, above, boiler = [0] * n, [0] * n, [0] * n
    in_main = [0] * n
    for i in range(1, n):
        p = page.parents[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.hints[p]
        boiler[i] = boiler[p] or int(page.tags[p] in _BOILER_TAGS)
        in_main[i] = in_main[p] or int(page.tags[p] in ("article", "main"))
        children[p] += 1
        rank_text[i] = children[p]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        text[p] += text[i]
        link[p] += link[i]
        mark[p] += mark[i]
        tags[p] += tags[i]
        control[p] += control[i]
        paragraphs[p] += paragraphs[i]
        heads[p] += heads[i]
        items[p] += items[i]
        nodes[p] += nodes[i]
        top[p] += top[i]
        hinted[p] |= hinted[i] | page.hints[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    a = lambda v: np.array(v, dtype=np.float64)
    parent = np.array(page.parents)
    parent[0] = 0
    t, o = a(text), a(own)
    total = max(seen, 1)
    f = np.zeros((n, N_FEATURES))
    for i, tag in enumerate(page.tags):
        if (k := _TAG_INDEX.get(tag)) is not None:
            f[i, k] = 1
    k = len(_TAGS)
    h, ab = np.array(page.hints), np.array(above)
    for g in range(len(_GROUPS)):
        f[:, k + g] = (h >> g) & 1
        f[:, k + len(_GROUPS) + g] = (ab >> g) & 1
    k += 2 * len(_GROUPS)
    own_boiler = (h & ~1) != 0
    columns = [
        np.minimum(a(depth), 12), np.log1p(t), np.log1p(o), t / total, a(link) / np.maximum(t, 1), np.minimum(t / np.maximum(a(tags), 1), 400),
        a(mark) / np.maximum(t, 1) * 50, np.log1p(a(paragraphs)), np.log1p(a(heads)), np.log1p(a(items)), np.log1p(a(control)), np.log1p(a(children)),
        np.log1p(a(children)[parent]), a(rank_text) / np.maximum(a(children)[parent], 1), t / np.maximum(t[parent], 1), a(first) / total, a(boiler), a(in_main),
        a(top), np.log1p(a(nodes)), t[parent] / total, a(page.n_tags)[parent], own_boiler, ((np.array(hinted) & ~1) != 0),
    ]
    f[:, k:] = np.stack(columns, axis=1)
    return f, pieces


# -- boosted trees ---------------------------------------------------------------------


@dataclass
class Boosted:
    base: float
    #: For each tree, complete to DEPTH: feature and bound of inner nodes, value of leaves.
    features: np.ndarray
    bounds: np.ndarray
    values: np.ndarray
    #: Log frequencies of a child's state under its parent's (outside, main, dropped).
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, v in zip(self.features, self.bounds, self.values):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            s += v[at - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-s))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Trees on the logistic loss; splits at quantile bounds, by the second-order gain."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, STEPS + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out = Boosted(float(np.log(rate / (1 - rate))), np.zeros((TREES, (1 << DEPTH) - 1), dtype=np.int64), np.full((TREES, (1 << DEPTH) - 1), np.inf), np.zeros((TREES, 1 << DEPTH)))
    s = np.full(n, out.base)
    width = STEPS + 1
    for k in range(TREES):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, dtype=np.int64)
        for d in range(DEPTH):
            low = (1 << d) - 1
            local = at - low
            size = 1 << d
            best = np.full(size, 1e-3)
            feature, bound = np.zeros(size, dtype=np.int64), np.full(size, np.inf)
            whole_g, whole_h = (np.bincount(local, w, minlength=size) for w in (g, h))
            for j in range(m):
                if not len(edges[j]):
                    continue
                cell = local * width + code[:, j]
                left_g, left_h = (np.cumsum(np.bincount(cell, w, minlength=size * width).reshape(size, width), axis=1)[:, : len(edges[j])] for w in (g, h))
                right_g, right_h = whole_g[:, None] - left_g, whole_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (whole_g**2 / (whole_h + 1))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(size), top]
                better = value > best
                best[better], feature[better], bound[better] = value[better], j, edges[j][top[better]]
            out.features[k, low : low + size], out.bounds[k, low : low + size] = feature, bound
            at = 2 * at + 1 + (x[np.arange(n), feature[local]] > bound[local])
        leaf = at - (1 << DEPTH) + 1
        out.values[k] = RATE * np.bincount(leaf, g, minlength=1 << DEPTH) / (np.bincount(leaf, h, minlength=1 << DEPTH) + 1)
        s += out.values[k][leaf]
    return out


# -- generated pages -------------------------------------------------------------------


class Generator:
    """Pages of many layouts. Text in the article is marked by a private-use character."""

    MARK = "\ue000"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int, main: bool) -> str:
        r = self.r
        out = ["".join(r.choice("aeioubcdlmnprst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi))]
        for i in range(0, len(out), 9):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += r.choice([".", ".", ",", "!"])
        if r.random() < 0.15:
            out = [w + " |" for w in out]
        return (self.MARK if main else "") + " ".join(out) + ("." if r.random() < 0.8 else "")

    def attr(self, names: str, chance: float = 0.85) -> str:
        r = self.r
        if r.random() > chance:
            return r.choice(["", f' class="c{r.randint(1, 99)}"'])
        name = r.choice(names.split())
        name = r.choice([name, name, f"{name}-{r.choice(['box', 'wrap', 'inner', 'area'])}", f"{r.choice(['site', 'page', 'block'])}-{name}"])
        return f" {r.choice(['class', 'class', 'id'])}={chr(34)}{name}{chr(34)}"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3, False)}</a></li>' for _ in range(n))

    def menu(self) -> str:
        body = f"<ul>{self.links(self.r.randint(3, 12))}</ul>"
        return f"<nav>{body}</nav>" if self.r.random() < 0.6 else f"<div{self.attr(_LEXICON['menu'], 0.95)}>{body}</div>"

    def advert(self) -> str:
        return f"<div{self.attr('ad ads advert advertisement promo sponsor sponsored', 0.97)}>{self.wrap(self.words(3, 40, False))}</div>"

    def wrap(self, text: str) -> str:
        return self.r.choice([text, f"<p>{text}</p>", f"<span>{text}</span>"])

    def notice(self) -> str:
        button = self.r.choice(["", "<button>OK</button>"])
        tag = self.r.choice(["div", "section", "aside"])
        return f"<{tag}{self.attr(_LEXICON['notice'], 0.97)}>{self.wrap(self.words(5, 50, False))}{button}</{tag}>"

    def form(self) -> str:
        return f"<form><label>{self.words(1, 4, False)}</label><input type=text><p>{self.words(2, 12, False)}</p><button>{self.words(1, 2, False)}</button></form>"

    def side(self) -> str:
        body = self.r.choice([f"<h3>{self.words(1, 4, False)}</h3><ul>{self.links(self.r.randint(2, 9))}</ul>", f"<p>{self.words(5, 60, False)}</p>", self.advert()])
        return f"<aside>{body}</aside>" if self.r.random() < 0.6 else f"<div{self.attr(_LEXICON['side'], 0.95)}>{body}</div>"

    def talk(self) -> str:
        each = "".join(f"<div{self.attr('comment reply', 0.8)}><b>{self.words(1, 2, False)}</b><p>{self.words(4, 60, False)}</p></div>" for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(["section", "div", "ul"])
        each = f"<h3>{self.words(1, 3, False)}</h3>" * (self.r.random() < 0.5) + each
        return f"<{tag}{self.attr('comments discussion replies disqus respond', 0.98)}>{each}{self.form() * (self.r.random() < 0.3)}</{tag}>"

    def foot(self) -> str:
        body = self.r.choice([f"&copy; {self.words(2, 20, False)}", f"<p>{self.words(3, 30, False)}</p>", f"<ul>{self.links(4)}</ul><p>{self.words(3, 15, False)}</p>"])
        return f"<footer>{body}</footer>" if self.r.random() < 0.7 else f"<div{self.attr(_LEXICON['foot'], 0.97)}>{body}</div>"

    def head(self) -> str:
        body = f"<a href='/'>{self.words(1, 4, False)}</a>" + self.r.choice(["", f"<p>{self.words(2, 12, False)}</p>", self.menu()])
        return f"<header>{body}</header>" if self.r.random() < 0.6 else f"<div{self.attr(_LEXICON['head'], 0.97)}>{body}</div>"

    def block(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            text = self.words(2 if r.random() < 0.2 else 12, 120, True)
            if r.random() < 0.2:
                text = text.replace(" ", f" <a href='/y'>{self.MARK}", 1) + "</a>" if " " in text else text
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"])
        if kind < 0.74:
            return f"<h{(k := r.randint(2, 4))}>{self.words(1, 8, True)}</h{k}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{self.words(2, 25, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4, True)}</td><td>{self.words(1, 4, True)}</td></tr>" for _ in range(3)) + "</table>"
        return r.choice([f"<blockquote>{self.words(5, 50, True)}</blockquote>", f"<pre>{self.words(3, 30, True)}</pre>", f"<figure><figcaption>{self.words(2, 15, True)}</figcaption></figure>"])

    def page(self) -> str:
        r = self.r
        tiny = r.random() < 0.25
        inside = [f"<p>{self.words(2, 9, True)}</p>" for _ in range(r.randint(1, 2))] if tiny else [self.block() for _ in range(r.randint(1, 14))]
        for make, chance in ((self.advert, 0.3), (self.side, 0.15), (self.talk, 0.12), (self.form, 0.1), (self.notice, 0.1), (self.menu, 0.06)):
            if r.random() < chance:
                inside.insert(r.randint(0, len(inside)), make())
        title = f"<h1>{self.words(2, 12, True)}</h1>" * (r.random() < 0.85)
        body = title + "".join(inside)
        shape = r.random()
        if shape < 0.55:
            body = f"<article>{body}</article>"
        elif shape < 0.7:
            body = f"<main>{body}</main>"
        elif shape < 0.95:
            body = f"<div{self.attr('content article post entry story main', 0.9)}>{body}</div>"
        if r.random() < 0.3:
            body = f"<{(t := r.choice(['main', 'div', 'section']))}{self.attr('content container wrapper layout main', 0.6)}>{body}</{t}>"
        some = lambda options, most: [r.choice(options)() for _ in range(r.randint(0, most))]
        before = ([self.head()] * (r.random() < 0.5)) + ([self.menu()] * (r.random() < 0.75)) + some([self.advert, self.notice, self.form, self.side], 3)
        after = some([self.advert, self.side, self.talk, self.talk, self.form, self.notice, self.menu], 3) + ([self.foot()] * (r.random() < 0.85))
        return f"<html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled(source: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Features, whether a node is main (all of its text is), its state, parents."""
    page = parse(source)
    n = len(page.tags)
    main, rest = [0] * n, [0] * n
    for node, text, _ in page.texts:
        if node >= 0 and text.strip():
            (main if Generator.MARK in text else rest)[node] += 1
    whole_main, whole_rest = main[:], rest[:]
    for i in range(n - 1, 0, -1):
        whole_main[page.parents[i]] += whole_main[i]
        whole_rest[page.parents[i]] += whole_rest[i]
    state = np.zeros(n, dtype=np.int64)
    for i in range(1, n):
        p = page.parents[i]
        if state[p] == 2 or not whole_main[i]:
            state[i] = 2
        elif state[p] == 1 or main[i] or page.tags[i] in ("article", "main") or not whole_rest[i]:
            state[i] = 1
    clean = Page(page.tags, page.hints, page.parents, [(k, t.replace(Generator.MARK, ""), a) for k, t, a in page.texts], page.controls, page.n_tags)
    return describe(clean)[0], (state == 1).astype(np.float64), state, page.parents


@lru_cache(maxsize=1)
def model(pages: int = PAGES, seed: int = 5) -> Boosted:
    g = Generator(seed)
    made = [labelled(g.page()) for _ in range(pages)]
    fitted = boost(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))
    moves = np.full((3, 3), -np.inf)
    counts = np.zeros((3, 3))
    for _, _, state, parents in made:
        np.add.at(counts, (state[np.array(parents[1:])], state[1:]), 1)
    for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        allowed = {0: (0, 1, 2), 1: (1, 2), 2: (2,)}[a]
        moves[a, b] = np.log((counts[a, b] + 1) / (sum(counts[a, c] for c in allowed) + len(allowed)))
    fitted.moves = moves
    return fitted


def decode(parents: list[int], p: np.ndarray, moves: np.ndarray) -> list[int]:
    """The states of greatest joint score."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    n = len(parents)
    score = [[no[i], yes[i], no[i]] for i in range(n)]
    (oo, om, ox), (_, mm, mx), (_, _, xx) = moves.tolist()
    for i in range(n - 1, 0, -1):
        o, m, x = score[i]
        up = score[parents[i]]
        up[0] += max(oo + o, om + m, ox + x)
        up[1] += max(mm + m, mx + x)
        up[2] += xx + x
    state = [0] * n
    for i in range(1, n):
        o, m, x = score[i]
        above = state[parents[i]]
        if above == 0:
            state[i] = int(np.argmax((oo + o, om + m, ox + x)))
        elif above == 1:
            state[i] = 1 if mm + m >= mx + x else 2
        else:
            state[i] = 2
    return state


def extract(sources: list[str | None], m: Boosted) -> list[str]:
    """The main texts of pages; their nodes are scored together."""
    pages = [parse(s or "") for s in sources]
    told = [describe(p) for p in pages]
    p = m.probability(np.concatenate([f for f, _ in told])) if told else np.zeros(0)
    out, at = [], 0
    for page, (f, pieces) in zip(pages, told):
        state = decode(page.parents, p[at : at + len(f)], m.moves)
        at += len(f)
        text = "".join(" " if node < 0 else piece if state[node] == 1 else "" for (node, _, _), piece in zip(page.texts, pieces))
        out.append(" ".join(text.split()))
    return out


def extract_pages(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """``keep`` columns, text, n_chars."""
    from pyspark.sql.types import StructType

    m = pages.sparkSession.sparkContext.broadcast(model())
    d = pages.select(*keep, F.col(column).cast("string").alias("_html"))
    schema = StructType([*pages.select(*keep).schema.fields, *StructType.fromDDL("text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.slice(i, 128)
                texts = extract(part.column(len(keep)).to_pylist(), m.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.fieldNames())

    return d.mapInArrow(run, schema)
