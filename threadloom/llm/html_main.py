"""Main text of web pages (operator 6): gradient-boosted trees over DOM nodes, decoded as a hierarchy.

Each block element gets the probability that it belongs to the article or holds it, from its tag, attribute tokens,
depth, siblings and the density of text and links in its subtree. Among all choices in which no element is kept whose
parent is dropped, the most likely one is taken, by one pass up and one down the tree. The text of kept elements, a block
for each run of text that no block element interrupts, is the result.

The trees learn, at each start, from pages that this module makes from a fixed seed: articles with and without semantic
tags, among menus, headers, footers, sidebars, notices, adverts, forms and comments. Pages of the input are not needed.

Pages are read whole, however broken their markup, in time linear in their length. A reference cut by a tag is none. Null and empty pages, and pages without an article, have an empty
text. Character references are decoded, white space in a block (a line break, too) is one space, blocks are joined by
one line feed. Rows are independent; repeats and extra columns change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .trees import FlatTrees, fit_trees

#: Fixed values of HTML: elements without an end tag, elements within a line, elements whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style head template noscript svg iframe object textarea select option math canvas audio video title".split())
#: Elements whose text is not markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: An open element that such a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("html body ul ol dl table tbody thead tfoot tr div section article main aside nav header footer form blockquote".split())
#: Tokens of tags, classes and ids in groups, one feature each.
GROUPS = (
    "nav menu navigation navbar breadcrumb breadcrumbs toc pagination pager links tabs",
    "header masthead head banner topbar logo brand site-header hero",
    "footer foot copyright colophon legal bottom",
    "aside sidebar side related widget recommended more trending popular rail tags promo-list complementary",
    "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial teaser dfp",
    "comment comments reply replies discussion disqus respond reader feedback thread",
    "form subscribe newsletter signup login search input fieldset register contact",
    "cookie consent notice alert popup modal gdpr message warning dialog toast overlay banner-notice",
    "article content main post entry story text body page-content maincontent",
    "share social follow author byline meta date tools print",
)
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
TAGS = ("p", "div", "li", "ul", "h1", "h2", "h3", "section", "article", "main", "blockquote", "pre", "table", "td", "nav", "aside", "header", "footer", "form", "figure")
_TAG = {t: i for i, t in enumerate(TAGS)}
_OPENING = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTE_OR_END = re.compile("[\"'>]")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TRUTH = re.compile(r'data-kept="([01])"')
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "content", "groups", "attributes", "own", "linked", "size", "links", "nodes", "stops", "paragraphs", "depth", "truth")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node] = []
        self.content: list[str | Node] = []  # text and block elements in order; None stands for a line break
        self.own = self.linked = self.stops = 0  # letters of own text, of it in links, full stops and commas
        self.depth = parent.depth + 1 if parent else 0
        self.groups, self.truth = 0, 1
        if parent:
            names = " ".join(x or y or z for x, y, z in _NAMED.findall(attributes)).lower() if attributes else ""
            for t in (tag, *names.split(), *_TOKEN.findall(names)):
                if t in _GROUP:
                    self.groups |= 1 << _GROUP[t]
            told = _TRUTH.search(attributes) if attributes else None
            self.truth = int(told[1]) if told else parent.truth


class Marks:
    """The tags of a page, found in time linear in its length whatever its quotes."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.hidden: set[int] = set()  # quotes from which no end of a tag can be reached

    def _end(self, start: int) -> int:
        """The first ">" from start that is not in quotes, or else the first; there is one."""
        at, seen = start, []
        while at <= self.last[">"]:
            i = _QUOTE_OR_END.search(self.page, at).start()
            c = self.page[i]
            if c == ">":
                return i
            if i in self.hidden:
                break
            seen.append(i)
            at = self.page.find(c, i + 1) + 1 if i < self.last[c] else i + 1  # a quote without its like is a letter
        self.hidden.update(seen)
        return self.page.find(">", start)

    def after(self, place: int) -> tuple[int, int, str, str, str] | None:
        """The next mark as (start, end, "/" of an end tag, name, attributes); the name of a comment or declaration is empty."""
        page = self.page
        if (m := _OPENING.search(page, place)) is None:
            return None
        start = m.start()
        if m[2] is None:
            close = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(close, start + (4 if close == "-->" else 2))
            return start, len(page) if end < 0 else end + len(close), "", "", ""
        if m.end() > self.last[">"]:  # no tag can end any more, a comment or declaration takes the rest
            found = min((x for x in (page.find("<!", start), page.find("<?", start)) if x >= 0), default=len(page))
            return found, len(page), "", "", ""
        end = self._end(m.end())
        return start, end + 1, m[1], m[2].lower(), page[m.end() : end].removesuffix("/")


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all block elements in page order, the root first."""
    root = Node("#", None)
    nodes, at = [root], root
    opened: list[tuple[str, Node]] = []  # every open element with the block element that holds it
    place, unseen, links = 0, 0, 0

    def text(part: str) -> None:
        if part and not unseen:
            at.content.append(part)
            n = len(part) if not part.isspace() else 0
            at.own += n
            at.stops += part.count(".") + part.count(",")
            if links:
                at.linked += n

    where: dict[str, list[int]] = {}  # places in opened of each tag, and of all holders

    def close(upto: int) -> None:
        nonlocal at, unseen, links
        while len(opened) > upto:
            tag, at = opened.pop()
            where[tag].pop()
            if tag in HOLDERS:
                where["holders"].pop()
            unseen -= tag in UNSEEN
            links -= tag == "a"

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    marks = Marks(page)
    while mark := marks.after(place):
        start, end, ending, tag, attributes = mark
        text(page[place:start])
        place = end
        if not tag:
            continue
        if ending:
            if (i := last(tag)) >= 0:
                close(i)
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not unseen:
                at.content.append(" ")
            continue
        if tag in RAW:
            after = re.compile(rf"</{tag}\s*+>", re.I).search(page, place)
            place = after.end() if after else len(page)
            continue
        if tag not in INLINE:
            ends = ENDS.get(tag, ())
            over = last("p", *ends)
            if over >= 0 and over >= (last("tr", "table") if tag in ("td", "th") else last("holders")):
                close(over)
        where.setdefault(tag, []).append(len(opened))
        if tag in HOLDERS:
            where.setdefault("holders", []).append(len(opened))
        opened.append((tag, at))
        unseen += tag in UNSEEN
        links += tag == "a"
        if tag not in INLINE and not unseen:
            node = Node(tag, at, attributes)
            at.children.append(node)
            at.content.append(node)
            nodes.append(node)
            at = node
    text(page[place:])
    return root, nodes


def features(nodes: list[Node]) -> list[list[float]]:
    """A row for each block element."""
    for v in nodes:
        v.size, v.links, v.nodes, v.paragraphs = v.own, v.linked, 1, int(v.tag == "p" and v.own > 60)
    for v in reversed(nodes[1:]):
        p = v.parent
        p.size += v.size
        p.links += v.links
        p.nodes += v.nodes
        p.paragraphs += v.paragraphs
        p.stops += v.stops
    root = nodes[0]
    total, out = max(1, root.size), []
    anywhere = 0
    for v in nodes:
        anywhere |= 1 << 12 if v.tag == "article" else 1 << 13 if v.tag == "main" else v.groups
    above: dict[Node, int] = {root: 0}
    places: dict[Node, tuple[int, int, int]] = {}
    for v in nodes:
        g = v.groups | (1 << 12 if v.tag == "article" else 1 << 13 if v.tag == "main" else 0)
        same = sum(c.tag == "p" for c in v.children)
        for i, c in enumerate(v.children):
            above[c] = above[v] | g
            places[c] = i, len(v.children), same
        a, (i, n, ps) = above[v], places.get(v, (0, 1, 0))
        row = [0.0] * (2 + len(TAGS))
        row[_TAG.get(v.tag, len(TAGS))] = 1.0
        row[-1] = float(v.tag in ("html", "body", "#"))
        row += [float(v.groups >> k & 1) for k in range(len(GROUPS))]
        row += [float(a >> k & 1) for k in range(len(GROUPS))]
        size = max(1, v.size)
        parent = v.parent or v
        row += [
            float(a >> 12 & 1), float(a >> 13 & 1), float(anywhere >> 12 & 1), float(anywhere >> 13 & 1), float(anywhere >> 8 & 1),
            math.log1p(v.size), v.size / total, v.links / size, size / v.nodes, v.stops / size, v.own / size, float(v.paragraphs), v.depth,
            i / max(1, n), n, ps, v.size / max(1, parent.size), parent.links / max(1, parent.size), math.log1p(parent.size), len(v.children),
        ]
        out.append(row)
    return out


def decode(nodes: list[Node], p: np.ndarray) -> set[Node]:
    """The most likely set of kept elements in which each but the root has its parent; the root is kept."""
    yes = dict(zip(nodes, np.log(np.clip(p, 1e-6, 1 - 1e-6)).tolist(), strict=True))
    no = dict(zip(nodes, np.log(1 - np.clip(p, 1e-6, 1 - 1e-6)).tolist(), strict=True))
    for v in reversed(nodes[1:]):
        parent = v.parent
        yes[parent] += max(yes[v], no[v])
        no[parent] += no[v]
    kept = {nodes[0]}
    for v in nodes[1:]:
        if v.parent in kept and yes[v] > no[v]:
            kept.add(v)
    return kept


def text_of(root: Node, kept: set[Node]) -> str:
    blocks, run = [], []

    def end() -> None:
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        v, i = todo.pop()
        while i < len(v.content):
            x = v.content[i]
            i += 1
            if isinstance(x, str):
                run.append(html.unescape(x) if "&" in x else x)  # each by itself: no reference goes on behind a tag
                continue
            end()
            if x in kept:
                todo.append((v, i))
                v, i = x, 0
        end()
    return "\n".join(blocks)


def _made_page(r: random.Random) -> str:
    """A page with data-kept on elements where the article starts or stops."""
    stem = ["ra", "ten", "lo", "mi", "ver", "sol", "qu", "est", "ing", "and", "or", "bel", "tion", "ha"]

    def words(n: int) -> str:
        s = " ".join("".join(r.choice(stem) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]) for _ in range(max(1, n)))
        return s.capitalize() + r.choice([".", ".", ""])

    def links(n: int, kept: str = "") -> str:
        item = r.choice(["<li><a href='/x'>{}</a></li>", "<li><a href=/x>{}</a>", "<a href='/x'>{}</a> | "])
        inner = "".join(item.format(words(r.randint(1, 3))) for _ in range(n))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def named(*names: str) -> str:
        if r.random() < 0.25:
            return ""
        return f' {r.choice(["class", "id", "class"])}="{r.choice(names)}"'

    def some(options: list[str]) -> str:
        return f'<{r.choice(["div", "section", "aside"])} data-kept="0"{r.choice(options)}>'

    def paragraph() -> str:
        size = r.choice([4, 12, 30, 60, 120, 250])
        body = words(size)
        if r.random() < 0.2:
            body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{words(3)}</b> {body}"
        if r.random() < 0.2:
            body += f" <a href='/y'>{words(3)}</a> {words(6)}"
        return f"<p>{body}" + r.choice(["</p>", "</p>", ""])

    def advert() -> str:
        tag = r.choice(["div", "div", "aside", "section"])
        return f'<{tag} data-kept="0" class="{r.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"])}">{r.choice(["", "<p>"])}{words(r.randint(3, 40))}</{tag}>'

    def notice() -> str:
        tag = r.choice(["div", "section", "div"])
        return f'<{tag} data-kept="0" {r.choice(["class", "id"])}="{r.choice(["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "gdpr"])}"><p>{words(r.randint(5, 60))}</p>{r.choice(["", "<button>Ok</button>"])}</{tag}>'

    def menu() -> str:
        if r.random() < 0.6:
            return f'<nav data-kept="0"{named("nav", "menu", "main-menu")}>{links(r.randint(2, 10))}</nav>'
        return f'<div data-kept="0" class="{r.choice(["menu", "nav", "navbar", "breadcrumbs", "navigation"])}">{links(r.randint(2, 10))}</div>'

    def form() -> str:
        return f'<form data-kept="0"{named("subscribe", "newsletter", "search", "login")}>{r.choice(["<p>", "<label>", "<div>"])}{words(r.randint(2, 25))}<input name=q></form>'

    def comments() -> str:
        tag = r.choice(["div", "section", "ul", "aside"])
        inner = "".join(f'<{t} class="{r.choice(["comment", "reply", "comment-body", "c"])}"><p>{words(r.randint(4, 80))}</p></{t}>' for t in [r.choice(["div", "li", "article", "div"])] * r.randint(1, 6))
        return f'<{tag} data-kept="0" {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "discussion", "disqus", "replies", "reader-comments"])}">{r.choice(["", "<h2>Comments</h2>", "<h3>" + words(2) + "</h3>"])}{inner}</{tag}>'

    def sidebar() -> str:
        tag = r.choice(["aside", "aside", "div"])
        names = named("sidebar", "related", "widget") if tag == "aside" else ' class="' + r.choice(["sidebar", "side", "related", "widget", "recommended", "rail"]) + '"'
        return f'<{tag} data-kept="0"{names}>{r.choice(["", "<h3>" + words(2) + "</h3>"])}{r.choice([links(r.randint(2, 6)), "<p>" + words(r.randint(4, 60)) + "</p>"])}</{tag}>'

    def extras(most: int, kinds: list) -> str:
        return "".join(r.choice(kinds)() for _ in range(r.randint(0, most)))

    within = [advert, notice, sidebar, form, comments]
    body = []
    if r.random() < 0.85:
        body.append(f"<h{(n := r.choice([1, 1, 2]))}>{words(r.randint(2, 12))}</h{n}>")
    for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 20])):
        body.append(paragraph() if r.random() < 0.85 else r.choice([lambda: f"<h2>{words(4)}</h2>", lambda: f"<blockquote>{words(20)}</blockquote>", lambda: "<ul>" + "".join(f"<li>{words(12)}</li>" for _ in range(3)) + "</ul>", lambda: f"<div>{words(30)}</div>", lambda: f"<pre>{words(15)}</pre>", lambda: f"<table><tr><td>{words(3)}<td>{words(4)}</table>"])())
        if r.random() < 0.06:
            body.append(r.choice(within)())
    inner = "".join(body)
    if r.random() < 0.15:
        inner = f'<header data-kept="0"><p>{words(5)}</p></header>{inner}<footer data-kept="0">{words(6)}</footer>'
    if r.random() < 0.25:
        inner = f'<div class="{r.choice(["content", "text", "body", "inner"])}">{inner}</div>'
    kind = r.random()
    if kind < 0.6:
        article = f'<article data-kept="1"{named("post", "article", "entry") if r.random() < 0.4 else ""}>{inner}</article>'
    elif kind < 0.75:
        article = f'<main data-kept="1">{inner}</main>'
    else:
        article = f'<div data-kept="1" {r.choice(["class", "id"])}="{r.choice(["content", "article", "post", "entry-content", "story", "main", "post-body", "article-body"])}">{inner}</div>'
    if r.random() < 0.25:
        article = f"<{(t := r.choice(['main', 'div', 'section']))}{named('content', 'wrap', 'page', 'container')}>{article}{extras(1, within)}</{t}>"
    before = [menu] * (r.random() < 0.8)
    top = "".join(x() for x in before) + extras(2, [advert, notice, form, sidebar, menu])
    if r.random() < 0.5:
        top = f'<header data-kept="0"{named("header", "masthead")}><h1>{words(3)}</h1>{r.choice(["", menu()])}{r.choice(["", "<p>" + words(8) + "</p>"])}</header>' + top
    if r.random() < 0.3:
        top = f'<div data-kept="0" class="{r.choice(["header", "masthead", "topbar", "site-header"])}">{words(4)}</div>' + top
    foot = f'<footer data-kept="0">{r.choice(["&copy; ", "<p>", ""])}{words(r.randint(3, 30))}</footer>' if r.random() < 0.75 else f'<div data-kept="0" class="{r.choice(["footer", "copyright", "site-footer"])}">{words(r.randint(3, 30))}</div>' if r.random() < 0.6 else ""
    page = f"{top}{article}{extras(3, [advert, sidebar, comments, form, notice])}{foot}"
    if r.random() < 0.2:
        return page
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body>{page}" + r.choice(["</body></html>", ""])


@lru_cache(maxsize=2)
def train_model(pages: int = 600, seed: int = 11) -> FlatTrees:
    """Labels: an element is kept if it is within the article or holds it."""
    r, x, y = random.Random(seed), [], []
    for _ in range(pages):
        root, nodes = parse(_made_page(r))
        held: set[Node] = set()
        for v in nodes:
            if v.truth and v.tag not in ("#", "html", "body") and any(w.truth and "data-kept" in w.attributes for w in _upward(v)):
                held.update(_upward(v))
        held.add(root)
        x += features(nodes)
        y += [float(v in held) for v in nodes]
    return fit_trees(np.array(x), np.array(y), trees=60, depth=5, rate=0.2, bins=32, least=5)


def _upward(v: Node) -> list[Node]:
    out = []
    while v is not None:
        out.append(v)
        v = v.parent
    return out


#: Elements whose features are held at once; a page with more is judged by itself.
NODES = 20_000


def main_texts(pages: list[str | None], model: FlatTrees) -> list[str]:
    out, held, rows = [], [], []

    def judge() -> None:
        p, at = model.probability(np.array(rows)) if rows else np.empty(0), 0
        for i, root, nodes in held:
            out[i] = text_of(root, decode(nodes, p[at : at + len(nodes)]))
            at += len(nodes)
        held.clear()
        rows.clear()

    for i, page in enumerate(pages):
        out.append("")
        if page:
            root, nodes = parse(page)
            held.append((i, root, nodes))
            rows += features(nodes)
            if len(rows) >= NODES:
                judge()
    judge()
    return out


def extract_main(pages: DataFrame, page: str = "html", out: str = "text", model: FlatTrees | None = None) -> DataFrame:
    """pages with a column more: the main text; a column of that name is replaced."""
    model = model or train_model()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(main_texts(s.tolist(), model), index=s.index, dtype=object)

    return bounded_batches(pages).withColumn(out, extract(F.col(page)))
