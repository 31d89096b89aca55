"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its elements with its text blocks as leaves. Each node is content or not; a node's own
evidence (tag, words of class, id and role, and for blocks length, links, punctuation and length against the page's longest
block outside links, footers and the like, apart for pages with and without an article element; blocks inside the first article or main
element, and not in a part of it that is set apart, are marked as such instead) and a table of
parent-child potentials give the joint distribution. Messages passed from the leaves up and from the root down
(sum-product) yield each block's exact marginal; blocks with EVEN or more are the text. The potentials are trained by
gradient ascent on the likelihood of labelled pages, which this module makes by laying out known articles among known
menus, notices, adverts, forms and comments in many ways: with and without telling names, as one paragraph or many, as
bare text (see `SHAPES`).

Within a block, references are decoded and white space of any kind, <br> included, becomes one blank; blocks are joined
by a line feed in page order. Null or empty pages give an empty text. Unclosed, stray and unknown tags are taken as
browsers mostly take them; a tag that the page breaks off in is no text. Whole pages are read in time that grows as
their length; nesting and length have no limit. Rows stand alone: repeated rows, null ids and urls and further columns
make no difference, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._cluster import tidy
from parlance.session import ship

EVEN, PAGES, ROUNDS, SEED = 0.5, 1000, 200, 3

#: A tag's name; a name with its value, or what stands between two. Quantifiers that give nothing back keep both linear.
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|\s++|.""", re.S)
_STOP = re.compile(r"""[>"']""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
#: Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAGS = "html body article main section div p h1 h2 h3 h4 ul ol li dl table tr td blockquote pre figure nav header footer aside form button select fieldset details address".split()
HINTS = "article content main post entry story body text page nav menu header masthead top footer bottom copyright legal sidebar side aside rail widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal gdpr comment comments reply discussion respond share social related recommended breadcrumb breadcrumbs login signup form search newsletter subscribe pagination tags meta toolbar skip disclaimer".split()
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_HINT_AT = {h: len(TAGS) + 1 + k for k, h in enumerate(HINTS)}
_BLOCK_AT = len(TAGS) + 1 + len(HINTS)
SIZE = _BLOCK_AT + 27
#: Elements and names that set apart what is not part of the article around it, and the few of these names that also do so on an article element itself.
APART = frozenset("nav aside footer form button select fieldset".split())
APART_HINTS = frozenset("nav menu footer copyright legal sidebar side aside rail widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal gdpr comment comments reply discussion respond share social related recommended breadcrumb breadcrumbs login signup form search newsletter subscribe pagination tags meta toolbar disclaimer".split())
_APART_AT = frozenset([_TAG_AT[t] for t in APART] + [_HINT_AT[h] for h in APART_HINTS])
_TALK_AT = frozenset(_HINT_AT[h] for h in ("comment", "comments", "reply"))
#: Where a block lies: in the first article element, in the main element of a page without one, in main beside the article, in a later article; whether linked or short there.
IN_ARTICLE, IN_MAIN, BESIDE, LATER, LINKED_INSIDE, SHORT_INSIDE = range(_BLOCK_AT + 21, _BLOCK_AT + 27)


#: Zones of a page: inside the first article, inside main, inside a later article of main, set apart from what is around.
_FIRST, _MAIN, _NEXT, _APART = 1, 2, 3, 4


class Tree:
    """Nodes in page order, so that parents come before children: parent, active features, and the text of blocks (None for elements)."""

    def __init__(self):
        self.parent, self.active, self.text, self.mark, self.zone = [], [], [], [], []

    def add(self, parent: int, active: list[int], text: str | None = None, mark: str = "", zone: int = 0) -> int:
        self.zone.append(zone)
        self.parent.append(parent)
        self.active.append(active)
        self.text.append(text)
        self.mark.append(mark)
        return len(self.parent) - 1


def _element(tag: str, attributes: str) -> tuple[list[int], str]:
    found, mark = {_TAG_AT.get(tag, len(TAGS))}, ""
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower() if m[1] else ""
        if name in ("class", "id", "role"):
            words = _WORD.findall((m[2] or m[3] or m[4] or "").lower())
            found.update(_HINT_AT[w] for w in words if w in _HINT_AT)
        elif name == "data-label":
            mark = m[2] or ""
    return list(found), mark


_cached_element = lru_cache(maxsize=4096)(_element)


def _block(text: str, linked: int) -> list[int]:
    n, k = len(text), _BLOCK_AT
    out = [k, k + 1 + min(5, int(math.log2(n + 1)) // 2)]
    share = linked / n
    out.append(k + 7 + (share > 0.33) + (share > 0.8))
    if text[-1] in ".!?:…\"»”":
        out.append(k + 10)
    if "©" in text[:40] or "copyright" in text[:80].lower() or "all rights reserved" in text[:200].lower():
        out.append(k + 11)
    return out


class Scanner:
    """Tags of a page, each found by moving forward only."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, past quoted values; -1 if the page breaks off before."""
        while at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if at <= self.last[m[0]]:
                at = self.page.find(m[0], at) + 1
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the end tag of an element whose content is no markup."""
        m = re.compile(f"</{re.escape(tag)}", re.I).search(self.page, at)
        close = self.page.find(">", m.end()) if m else -1
        return close + 1 or len(self.page)


def parse(page: str) -> Tree:
    """The tree of a page."""
    tree = Tree()
    stack = [("", tree.add(-1, [len(TAGS)]))]  # block elements that are open, with their nodes
    is_open: dict[str, int] = {}  # how many of each there are
    scan = Scanner(page)
    parts: list[str] = []
    linked = links = at = 0
    n, met = len(page), set()

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tree.add(stack[-1][1], _block(text, min(linked, len(text))), text, zone=tree.zone[stack[-1][1]])
        linked = 0

    def close(upto: int):
        nonlocal links
        flush()
        for tag, _ in stack[upto:]:
            is_open[tag] -= 1
        del stack[upto:]
        links = 0

    def write(piece: str):
        nonlocal linked
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            write(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt + 2)
            at = end + 1 if end >= 0 else n
            continue
        m = _NAME.match(page, lt + 1)
        if m is None:
            write("<")
            at = lt + 1
            continue
        end = scan.end(m.end())
        if end < 0:
            break
        at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and is_open.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                at = scan.raw_end(tag, at)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links += 1
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES:
            if any(map(is_open.get, CLOSES[tag])):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in HOLDS[tag]:
                        break
                    if stack[k][0] in CLOSES[tag]:
                        close(k)
        elif stack[-1][0] == "p" or (tag in HEADINGS and stack[-1][0] in HEADINGS):
            close(len(stack) - 1)
        active, mark = _cached_element(tag, attributes) if len(attributes) < 200 else _element(tag, attributes)
        around = zone = tree.zone[stack[-1][1]]
        if tag in ("article", "main"):
            if around != _APART and tag not in met and _TALK_AT.isdisjoint(active):
                met.add(tag)
                active, zone = [k for k in active if k not in _APART_AT] + [_BLOCK_AT + 20], _FIRST if tag == "article" else _MAIN  # whatever it is called
            elif around == _MAIN:
                zone = _NEXT
        if _APART_AT.intersection(active):
            zone = _APART
        stack.append((tag, tree.add(stack[-1][1], active, None, mark, zone)))
        is_open[tag] = is_open.get(tag, 0) + 1
    flush()
    loose = [len(t) if t is not None and _BLOCK_AT + 7 in a and z != _APART else 0 for t, a, z in zip(tree.text, tree.active, tree.zone, strict=True)]
    longest, alone = max(loose), "article" not in met
    for text, size, active, zone in zip(tree.text, loose, tree.active, tree.zone, strict=True):
        if text is None:
            continue
        if zone == _FIRST or (zone == _MAIN and alone):  # neither its length nor its links count as elsewhere
            active.append(IN_ARTICLE if zone == _FIRST else IN_MAIN)
            if _BLOCK_AT + 7 not in active:
                active.append(LINKED_INSIDE)
            if len(text) < 32:
                active.append(SHORT_INSIDE)
            continue
        if zone in (_MAIN, _NEXT):
            active.append(BESIDE if zone == _MAIN else LATER)
        if size:
            active.append(_BLOCK_AT + (12 if met else 16) + (0 if size == longest else 1 if size * 3 >= longest else 2 if size * 10 >= longest else 3))
    return tree


class Model:
    """Weights of the evidence for content, and log potentials of (parent, child) states: for elements and for blocks."""

    def __init__(self):
        self.w = np.zeros(SIZE)
        self.pair = np.zeros((2, 2, 2))

    def marginals(self, tree: Tree) -> tuple[list[float], np.ndarray]:
        """P(content) of each node, and the expected counts of parent-child states by kind of child."""
        w, n = self.w.tolist(), len(tree.parent)
        own = [sum([w[k] for k in a]) for a in tree.active]  # log odds of each node's own evidence
        up = own[:]  # log odds of all evidence at or below a node
        e = np.exp(self.pair)
        (a00, a01), (a10, a11) = e[0].tolist()
        (b00, b01), (b10, b11) = e[1].tolist()
        sent = [0.0] * n
        exp, log = math.exp, math.log
        for k in range(n - 1, 0, -1):
            o = exp(min(50.0, max(-50.0, up[k])))
            sent[k] = log((b10 + b11 * o) / (b00 + b01 * o)) if tree.text[k] is not None else log((a10 + a11 * o) / (a00 + a01 * o))
            up[tree.parent[k]] += sent[k]
        both = up[:]
        p = [0.0] * n
        counts = np.zeros((2, 2, 2))
        p[0] = 1 / (1 + exp(-min(50.0, max(-50.0, both[0]))))
        for k in range(1, n):
            block = tree.text[k] is not None
            rest = exp(min(50.0, max(-50.0, both[tree.parent[k]] - sent[k])))  # odds of the parent without this child
            o = exp(min(50.0, max(-50.0, up[k])))
            s = (b00, b01 * o, b10 * rest, b11 * rest * o) if block else (a00, a01 * o, a10 * rest, a11 * rest * o)
            total = sum(s)
            both[k] = up[k] + log(((s[1] + s[3]) / o) / (s[0] + s[2]))
            p[k] = (s[1] + s[3]) / total
            c = counts[int(block)]
            c[0, 0] += s[0] / total
            c[0, 1] += s[1] / total
            c[1, 0] += s[2] / total
            c[1, 1] += s[3] / total
        return p, counts

    def fit(self, pages: list[tuple[Tree, list[int]]], rounds: int = ROUNDS, rate: float = 0.15, l2: float = 1e-4) -> Model:
        """Gradient ascent on all pages at once: messages pass a level of depth at a time, over all trees."""
        sizes = [len(y) for _, y in pages]
        first = np.concatenate([[0], np.cumsum(sizes)])
        nodes = int(first[-1])
        parent = np.concatenate([np.array(tree.parent) + at for (tree, _), at in zip(pages, first, strict=False)])
        root = np.zeros(nodes, bool)
        root[first[:-1]] = True
        parent[root] = 0
        block = np.array([t is not None for tree, _ in pages for t in tree.text], int)
        y = np.array([v for _, ys in pages for v in ys])
        lens = np.array([len(a) for tree, _ in pages for a in tree.active])
        at, active = np.repeat(np.arange(nodes), lens), np.array([x for tree, _ in pages for a in tree.active for x in a])
        depth = np.zeros(nodes, int)
        for k in range(nodes):
            depth[k] = 0 if root[k] else depth[parent[k]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        below = np.flatnonzero(~root)
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (block[below], y[parent[below]], y[below]), 1)
        m, v = [np.zeros_like(self.w), np.zeros_like(self.pair)], [np.zeros_like(self.w), np.zeros_like(self.pair)]
        for t in range(1, rounds + 1):
            e = np.exp(self.pair)[block]  # node, parent state, own state
            up, sent = np.bincount(at, self.w[active], nodes), np.zeros(nodes)
            for own in reversed(levels):
                o = np.exp(np.clip(up[own], -50, 50))
                sent[own] = np.log((e[own, 1, 0] + e[own, 1, 1] * o) / (e[own, 0, 0] + e[own, 0, 1] * o))
                np.add.at(up, parent[own], sent[own])
            both, counts = up.copy(), np.zeros((2, 2, 2))
            for own in levels:
                rest = np.exp(np.clip(both[parent[own]] - sent[own], -50, 50))
                o = np.exp(np.clip(up[own], -50, 50))
                s = np.stack([e[own, 0, 0], e[own, 0, 1] * o, e[own, 1, 0] * rest, e[own, 1, 1] * rest * o], 1)
                both[own] = up[own] + np.log(((s[:, 1] + s[:, 3]) / o) / (s[:, 0] + s[:, 2]))
                share = s / s.sum(1, keepdims=True)
                for kind in (0, 1):
                    counts[kind] += share[block[own] == kind].sum(0).reshape(2, 2)
            p = 1 / (1 + np.exp(-np.clip(both, -50, 50)))
            gw = np.bincount(active, (y - p)[at], SIZE) - l2 * nodes * self.w / 10
            gp = seen - counts - l2 * nodes * self.pair / 10
            for k, (x, g) in enumerate(((self.w, gw / nodes), (self.pair, gp / nodes))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def text(self, page: str) -> str:
        tree = parse(page)
        p, _ = self.marginals(tree)
        return "\n".join(t for t, x in zip(tree.text, p, strict=True) if t is not None and x >= EVEN)


#: What made-up pages look like: a telling layout; an article element and little else; text among links without telling names; bare text.
SHAPES = ("laid out", "short article", "plain", "bare", "nested")


def labelled_page(r: random.Random, shape: str = SHAPES[0]) -> str:
    """A made-up page of a shape whose content blocks and boilerplate are known by a data-label attribute."""
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    shut = lambda tag: "" if tag in ("p", "li") and r.random() < 0.3 else f"</{tag}>"
    named = lambda *names: r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}"'])
    sure = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()}-{r.choice(names)}"', f' class="{r.choice(names)}-{word()}"'])

    def paragraph(junk=False):
        body = words(*r.choice([(1, 3), (4, 15), (15, 60), (40, 120)])) + r.choice([".", ".", "!", "", ""])
        if r.random() < 0.2:
            body = f"<b>{body}" + r.choice(["</b>", ""])
        if r.random() < 0.2:
            body += " " + link(words(1, 3)) + " " + words(2, 8) + "."
        if r.random() < 0.15:
            body += "<br>" + words(3, 20)
        return body

    def content():
        kind = r.random()
        if kind < 0.75:
            return f"<p{r.choice(['', '', named('text', 'lead')])}>{paragraph()}{shut('p')}"
        if kind < 0.85:
            tag = r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{words(1, 8)}</{tag}>"
        if kind < 0.92:
            tag = r.choice(["ul", "ol"])
            inner = lambda: r.choice(["", "", "", f"<ul><li>{words(2, 9)}{shut('li')}<li>{words(2, 12)}{shut('li')}</ul>"])
            return f"<{tag}>" + "".join(f"<li>{words(2, 20)}{inner()}{shut('li')}" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.96:
            return f"<blockquote>{r.choice(['<p>', ''])}{words(5, 40)}.</blockquote>"
        return r.choice([f"<pre>{words(4, 20)}</pre>", f"<div>{words(5, 40)}.</div>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(3, 9)}</figcaption></figure>"])

    links = lambda a, b: "<ul>" + "".join(f"<li>{link(words(1, 3))}{shut('li')}" for _ in range(r.randint(a, b))) + "</ul>"
    prose = lambda: r.choice([words(3, 25) + ".", f"<p>{words(3, 40)}.</p>", f"<p>{words(2, 9)}</p><p>{words(3, 20)}.</p>"])
    field = lambda: f"<form{named('search', 'login', 'newsletter')}><label>{words(1, 4)}</label><input name=q>{r.choice(['', f'<p>{words(4, 18)}.</p>'])}<button>{words(1, 2)}</button></form>"
    junk = {
        "menu": lambda: r.choice([f"<nav>{links(3, 8)}</nav>", f"<div{sure('nav', 'menu', 'breadcrumb', 'toolbar')}>{r.choice([links(3, 8), ' | '.join(link(words(1, 2)) for _ in range(5))])}</div>", f"<ul{sure('menu', 'nav')}>{links(2, 6)[4:]}"]),
        "header": lambda: r.choice([f"<header>{r.choice([f'<h1>{words(1, 3)}</h1>', link(words(1, 3)), ''])}<p>{words(2, 8)}</p></header>", f"<div{sure('header', 'masthead', 'top')}>{r.choice([prose(), link(words(1, 3))])}</div>"]),
        "footer": lambda: r.choice([f"<footer>{r.choice(['&copy; ', 'Copyright ', ''])}{r.choice([prose(), prose(), words(20, 120) + '.'])}</footer>", f"<div{sure('footer', 'bottom', 'copyright', 'legal')}>{r.choice(['&copy; ', ''])}{prose()}</div>"]),
        "sidebar": lambda: r.choice([f"<aside>{r.choice([prose(), '<h3>' + words(1, 3) + '</h3>' + links(3, 6)])}</aside>", f"<div{sure('sidebar', 'side', 'rail', 'widget', 'related', 'recommended')}>{r.choice(['', '<h3>' + words(1, 4) + '</h3>'])}{r.choice([prose(), links(3, 6)])}</div>"]),
        "ad": lambda: f"<{'div'}{sure('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsor', 'sponsored')}>{prose()}</div>",
        "notice": lambda: f"<{r.choice(['div', 'section'])}{sure('cookie', 'consent', 'notice', 'alert', 'popup', 'modal', 'gdpr')}>{prose()}{r.choice(['', '<button>' + word() + '</button>'])}</".replace("</", "</", 1) + "div>",
        "form": field,
        "share": lambda: f"<div{sure('share', 'social', 'tags', 'meta', 'pagination')}>{r.choice([links(2, 5), words(1, 6)])}</div>",
        "comments": lambda: f"<{(tag := r.choice(['div', 'section', 'ol']))}{sure('comment', 'comments', 'discussion', 'respond', 'reply')}>{r.choice(['', '<h3>' + words(1, 3) + '</h3>'])}" + "".join(f"<{(t := r.choice(['div', 'article', 'li']))}{named('comment', 'reply')}>{r.choice(['', '<b>' + word() + '</b>'])}<p>{paragraph()}</p></{t}>" for _ in range(r.randint(1, 5))) + f"</{tag}>",
    }
    marked = lambda kind: f'<div data-label="no">{junk[kind]()}</div>'
    page = lambda inside: f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{inside}" + r.choice(["</body></html>", ""])
    no = lambda x: f'<div data-label="no">{x}</div>'
    long = lambda: words(*r.choice([(5, 12), (10, 30), (25, 80), (60, 160)])) + r.choice([".", ".", ".", "!", "?", ""])
    several = lambda: r.choice([1, 1, 2, 3, 5, 9])
    if shape == "short article":
        inside = [r.choice(["", f"<h1>{words(2, 10)}</h1>", f"<h2>{words(2, 10)}</h2>"])]
        for k in range(several()):
            inside.append(r.choice([content(), f"<p>{long()}{shut('p')}", f"<p>{long()}{shut('p')}", f"<p>{long()}{shut('p')}", long() if not k else f"<div>{long()}</div>"]))
            if r.random() < 0.15:
                inside.append(no(f"<div{sure('newsletter', 'signup', 'promo', 'ad', 'related', 'share')}>{r.choice([f'<p>{words(3, 15)}.</p>', words(3, 15), f'<h3>{words(1, 4)}</h3>' + links(2, 4)])}</div>"))
        tag = r.choice(["article", "article", "main"])
        tail = "".join(marked(k) for k in ("comments", "footer", "sidebar", "menu") if r.random() < 0.2)
        head = "".join(marked(k) for k in ("header", "menu", "notice") if r.random() < 0.2)
        return page(head + f'<{tag}{named("post", "entry", word())} data-label="yes">' + "".join(inside) + f"</{tag}>" + tail)
    copyright_line = lambda: r.choice([f"&copy; {words(1, 6)}", f"{words(1, 3)}. All rights reserved.", "All rights reserved.", f"Copyright {words(2, 8)}."])
    last = lambda: no(r.choice([f"<footer>{words(3, 20)}.</footer>", f"<footer><p>{words(20, 160)}.</p></footer>", f"<footer>{words(20, 160)}</footer>", f"<div>{copyright_line()}</div>", f"<p>{copyright_line()}</p>", f"<footer>{copyright_line()}</footer>"]))
    if shape == "nested":  # an article in main or in a division, often a single sentence; its own name may lie; readers' comments are articles too
        linked = lambda: "<ul>" + "".join(f"<li>{link(words(2, 12))}{r.choice(['', ' ' + words(1, 8)])}{shut('li')}" for _ in range(r.randint(1, 6))) + "</ul>"
        inside = [r.choice(["", "", f"<h1>{words(1, 10)}</h1>", f"<header><h1>{words(2, 10)}</h1></header>"])]
        for _ in range(r.choice([1, 1, 1, 2, 3, 6])):
            inside.append(r.choice([content, lambda: f"<p>{long()}{shut('p')}", lambda: f"<p>{long()}{shut('p')}", linked, lambda: f"<p>{link(words(4, 30))}{r.choice(['', '.'])}{shut('p')}", long])())
            if r.random() < 0.1:
                inside.append(marked(r.choice(["ad", "share", "form", "sidebar", "menu"])))
        lie = f' class="{r.choice(sorted(APART_HINTS - {"comment", "comments", "reply"}))}-{word()}"'
        tag = r.choice(["article", "article", "article", "main"])
        text = f'<{tag}{r.choice(["", "", named("post", "entry", "story", word()), lie])} data-label="yes">' + "".join(inside) + f"</{tag}>"
        talk = [no(f"<article{named('comment', 'reply')}>{r.choice(['', '<b>' + word() + '</b>'])}<p>{paragraph()}</p></article>") for _ in range(r.choice([0, 0, 0, 1, 3, 5]))] if tag == "article" else []
        talk = [no(f"<{(t := r.choice(['section', 'div']))}{sure('comments', 'discussion')}>" + "".join(talk) + f"</{t}>")] if talk and r.random() < 0.4 else talk
        near = [marked(k) for k in ("sidebar", "menu", "ad", "share") if r.random() < 0.15]
        if tag == "article" and r.random() < 0.6:
            text = f"<main{named('page', 'content', 'main', 'wrapper')}>" + text + "".join(talk + near) + "</main>"
        elif r.random() < 0.7:
            text = f"<div{sure('content', 'page', 'main', 'container', 'body')}>" + text + "".join(near) + "</div>" + "".join(talk)
        else:
            text += "".join(talk)
        return page("".join(marked(k) for k in ("header", "menu", "notice") if r.random() < 0.2) + text + r.choice(["", "", last(), last(), marked("footer")]))
    if shape in ("plain", "bare"):
        tag = r.choice(["p", "p", "div"])
        one = lambda: f"<{tag}>{long()}{shut(tag)}" if shape == "plain" else long() + r.choice(["<br><br>", "<p>", "<hr>"])
        text = r.choice(["", f"<h1>{words(2, 10)}</h1>"]) + "".join(one() for _ in range(several()))
        text = f'<div data-label="yes">{text}</div>' if r.random() < 0.3 else f'<center data-label="yes">{text}</center>' if shape == "bare" else f'<div data-label="yes">{r.choice(["<div>", ""])}{text}</div>'
        menu = lambda: no(r.choice([links(2, 6), "".join(f"<div>{link(words(1, 3))}</div>" for _ in range(r.randint(2, 5))), "<p>" + " | ".join(link(words(1, 2)) for _ in range(r.randint(2, 6))) + "</p>", " ".join(link(words(1, 2)) for _ in range(3)), f"<table><tr><td>{link(words(1, 2))}<td>{link(words(1, 2))}</table>"]))
        foot = lambda: no(r.choice([f"<p>&copy; {words(1, 6)}</p>", f"<div>Copyright {words(2, 8)}.</div>", f"<hr><small>&copy; {words(2, 6)}</small>"]))
        return page(r.choice(["", "", menu()]) + text + r.choice(["", menu()]) + r.choice(["", "", foot(), last()]))
    body = [r.choice([f"<h1>{words(2, 12)}</h1>", f"<h1>{words(2, 12)}</h1>", f"<header><h1>{words(2, 12)}</h1></header>", ""])]
    for _ in range(r.choice([1, 2, 4, 8, 15])):
        body.append(content())
        if r.random() < 0.08:
            body.append(marked(r.choice(["ad", "share", "form", "sidebar", "notice"])))
    if r.random() < 0.25:
        body.append(marked(r.choice(["comments", "share", "footer", "form"])))
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    own = sure("content", "main", "post", "entry", "story", "article", "body", "text") if tag in ("div", "section") else named("post", "entry", "content", word())
    article = f'<{tag}{own} data-label="yes">' + "".join(body) + f"</{tag}>"
    for _ in range(r.choice([0, 0, 1, 2])):
        wrap = r.choice(["div", "main", "section"])
        near = [marked(k) for k in r.sample(["sidebar", "ad", "share", "comments", "menu"], r.choice([0, 0, 1, 2]))]
        cut = r.randint(0, len(near))
        article = f"<{wrap}{named('page', 'wrapper', 'container', 'main')}>" + "".join(near[:cut]) + article + "".join(near[cut:]) + f"</{wrap}>"
    before = [marked(k) for k in ("notice", "header", "menu", "ad", "form") if r.random() < 0.5]
    after = [marked(k) for k in ("comments", "sidebar", "ad", "form", "notice", "footer") if r.random() < 0.45]
    r.shuffle(before)
    return page("".join(before) + article + "".join(after))


def labels(tree: Tree) -> list[int]:
    """States from data-label: blocks take that of the nearest labelled element around them, elements that of most of their text."""
    near, yes, no = [""] * len(tree.parent), [0] * len(tree.parent), [0] * len(tree.parent)
    for k in range(len(tree.parent)):
        near[k] = tree.mark[k] or (near[tree.parent[k]] if k else "")
        if tree.text[k] is not None:
            yes[k], no[k] = (len(tree.text[k]), 0) if near[k] == "yes" else (0, len(tree.text[k]))
    for k in range(len(tree.parent) - 1, 0, -1):
        yes[tree.parent[k]] += yes[k]
        no[tree.parent[k]] += no[k]
    return [int(y > n) for y, n in zip(yes, no, strict=True)]


def _bare(tree: Tree) -> Tree:
    """The tree without the wrappers that only carry a label."""
    out, new = Tree(), {}
    for k in range(len(tree.parent)):
        if tree.mark[k] == "no":
            new[k] = new[tree.parent[k]]
        else:
            new[k] = out.add(new[tree.parent[k]] if k else -1, tree.active[k], tree.text[k], tree.mark[k], tree.zone[k])
    return out


def known(page: str) -> tuple[Tree, list[int]]:
    """The tree of a labelled page, without its labels, and the states of the nodes."""
    tree = parse(page)
    return _bare(tree), [s for s, m in zip(labels(tree), tree.mark, strict=True) if m != "no"]


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model fitted to made-up pages; the same on every call."""
    r = random.Random(seed)
    sample = []
    for k in range(pages):
        sample.append(known(labelled_page(r, SHAPES[k % len(SHAPES)] if k % 2 else SHAPES[0])))
    return Model().fit(sample)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        m = model.value
        for batch in batches:
            texts = [m.text(page) if page else "" for page in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(tidy(run), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
