"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of text. Each node holds main text,
other text or some of each; what is seen of a node (its tag and its parent's, the words of its class,
id and role, and for text its length, share of links and closing mark) depends on its own state, and
its state on that of its parent. Two
passes of sum-product messages, from the leaves up and from the root down, give each node's marginal
given the whole page; text whose marginal of being content reaches one half is kept.

The tables of the model are smoothed counts over labelled pages: layouts kept here with known
labels, and a bounded sample of the given pages (``TRAIN_PAGES``, by hash order) whose markup names
one article; within it, menus, asides, forms and the like are labelled as not content. Half of
those pages are counted with the article's own tag hidden, so that the rest of the evidence has to
carry the decision where a page has no such tag.

Scripts, styles, forms' controls and other elements that hold no prose are never text. Broken markup
is read as browsers do where it matters here: unclosed paragraphs and list items end at the next,
unmatched end tags are ignored, raw elements end at their own end tag only.

Defined results: a null or empty page gives an empty text. Text outside all blocks belongs to the
page's root. Pages are read whole; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import hash_sample

TRAIN_PAGES = 300
SMOOTH = 0.5
CONTENT = 0.5  # least marginal of kept text

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object audio video canvas".split())
HIDDEN = RAW | frozenset("head button select option datalist label input legend".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSED_BY = {  # an open element of this tag ends where one of these starts
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
}
SCOPE = frozenset(["table", "ul", "ol", "dl", "body", "html", "article", "section", "div", "main"])  # implied ends stop here

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # a text run's pieces
    linked: int = 0  # of its characters, in links
    text: str = ""


def parse(page: str) -> list[Node]:
    """Block elements and text runs ("#text") in page order; parents come before their children."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their block
    run = -1  # the open text run
    hidden = links = 0

    def add(piece: str) -> None:
        nonlocal run
        if run < 0:
            if not piece.strip():
                return
            run = len(nodes)
            nodes.append(Node("#text", stack[-1][1]))
        nodes[run].parts.append(piece)
        if links:
            nodes[run].linked += len(piece.strip())

    def close(to: int) -> None:
        nonlocal run, hidden, links
        while len(stack) > to:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag not in INLINE:
                run = -1

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not hidden:
            piece = page[at : m.start() if m else len(page)]
            if piece:
                add(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "br" and not hidden:
                add(" ")
            elif tag == "hr":
                run = -1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            run = run if tag in ("object", "svg", "math") else -1
            at = end.start() if end else len(page)
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if (open_tag == "p" and tag not in ("ruby",)) or tag in CLOSED_BY.get(open_tag, ()):
                    close(i)
                    break
                if open_tag in SCOPE:
                    break
            run = -1
            names = [p.lower() for g in _NAMES.findall(m[3]) for p in _PART.findall("".join(g))] if m[3] else []
            stack.append((tag, len(nodes)))
            nodes.append(Node(tag, stack[-2][1], names))
        else:
            stack.append((tag, stack[-1][1]))
        hidden += tag in HIDDEN
        links += tag == "a"
    for n in nodes:
        if n.tag == "#text":
            n.text = " ".join("".join(n.parts).split())
    return nodes


def features(nodes: list[Node], i: int) -> list[str]:
    """What is seen of a node."""
    node = nodes[i]
    above = f"under {nodes[node.parent].tag}" if i else "under none"
    if node.tag != "#text":
        return [f"tag {node.tag}", above, *[f"name {n}" for n in sorted(set(node.names))]]
    size = len(node.text)
    density = node.linked / size if size else 0.0
    return [
        above,
        f"size {min(5, int(math.log2(size + 1)) // 2)}",
        f"links {'none' if not node.linked else 'some' if density < 0.6 else 'most'}",
        f"end {'stop' if node.text[-1:] in '.!?:;…' else 'other'}",
    ]


OTHER, MAIN, MIXED = range(3)  # states: all other text, all main text, some of each
_STATES = range(3)


class Model:
    """Chances of a state given the parent's and of what is seen given the state."""

    def __init__(self) -> None:
        self.seen = [defaultdict(float) for _ in _STATES]
        self.kinds = [defaultdict(float) for _ in _STATES]
        self.step = [[SMOOTH * (p == y or p == MIXED) + 0.001 for y in _STATES] for p in _STATES]
        self.values: dict[str, set[str]] = defaultdict(set)
        self.count = [SMOOTH] * 3

    def learn(self, nodes: list[Node], states: list[int], hide: frozenset[str] = frozenset()) -> None:
        for i, n in enumerate(nodes):
            y = states[i]
            if i:
                self.step[states[n.parent]][y] += 1
            self.count[y] += 1
            for f in features(nodes, i):
                kind, _, value = f.partition(" ")
                if kind in ("tag", "under") and value in hide:
                    continue
                self.values[kind].add(value)
                self.seen[y][f] += 1
                self.kinds[y][kind] += 1

    def finish(self) -> Model:
        """Turn counts into logs; names are seen or not, other kinds have one value each."""
        self.odds: dict[str, tuple[float, ...]] = {}
        for kind, values in self.values.items():
            for value in values:
                f = f"{kind} {value}"
                if kind == "name":
                    chance = [(self.seen[y][f] + 0.2) / (self.count[y] + 1.0) for y in _STATES]
                else:
                    chance = [(self.seen[y][f] + SMOOTH) / (self.kinds[y][kind] + SMOOTH * (len(values) + 1)) for y in _STATES]
                self.odds[f] = tuple(map(math.log, chance))
        self.trans = [[self.step[p][y] / sum(self.step[p]) for y in _STATES] for p in _STATES]
        self.known: dict[tuple, tuple[float, ...]] = {}
        del self.seen, self.kinds, self.values
        return self

    def evidence(self, nodes: list[Node], i: int) -> tuple[float, ...]:
        """Chances of what is seen of a node, largest one, kept by what is seen."""
        n = nodes[i]
        seen = features(nodes, i)
        key = (n.tag == "#text", *seen)
        found = self.known.get(key)
        if found is None:
            logs = [0.0, 0.0, -50.0 if n.tag == "#text" else 0.0]
            for f in seen:
                for y, o in enumerate(self.odds.get(f, ())):
                    logs[y] += o
            top = max(logs)
            found = tuple(math.exp(x - top) for x in logs)
            if len(self.known) < 100_000:
                self.known[key] = found
        return found

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance that each node is main text, given the page: messages up, then down.

        Messages are scaled to a largest value of one, so products over many children stay finite.
        """
        own = [list(self.evidence(nodes, i)) for i in range(len(nodes))]
        (p00, p01, p02), (p10, p11, p12), (p20, p21, p22) = self.trans
        up: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = own[i]
            x, y, z = p00 * a + p01 * b + p02 * c, p10 * a + p11 * b + p12 * c, p20 * a + p21 * b + p22 * c
            up[i] = (x, y, z)
            total = own[nodes[i].parent]
            x, y, z = x * total[0], y * total[1], z * total[2]
            top = max(x, y, z)
            total[0], total[1], total[2] = x / top, y / top, z / top
        out = [0.0] * len(nodes)
        down: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * len(nodes)
        for i, n in enumerate(nodes):
            if i:
                d, o, u = down[n.parent], own[n.parent], up[i]
                a, b, c = d[0] * o[0] / u[0], d[1] * o[1] / u[1], d[2] * o[2] / u[2]
                x, y, z = a * p00 + b * p10 + c * p20, a * p01 + b * p11 + c * p21, a * p02 + b * p12 + c * p22
                top = max(x, y, z)
                down[i] = (x / top, y / top, z / top)
            a, b, c = down[i]
            x, y, z = own[i]
            b *= y
            out[i] = b / (a * x + b + c * z)
        return out


# Labelled layouts: C and c stand for long and short content, B and b for other text.
LAYOUTS = (
    "<header class=site-header><div class=logo>[b]</div><nav class=menu><ul><li><a>[b]</a><li><a>[b]</a><li><a>[b]</a></ul></nav></header><main><article><h1>[c]</h1><p>[C]<p>[C]<p>[c]<h2>[c]</h2><p>[C]</article></main><aside class=sidebar><h3>[b]</h3><ul><li><a>[b]</a><li><a>[b]</a></ul></aside><footer><p>[b]</p><p>[B]</p></footer>",
    "<div id=header><h1><a>[b]</a></h1></div><div id=nav><a>[b]</a> <a>[b]</a></div><div id=content><h2>[c]</h2><p>[C]</p><p>[c]</p><blockquote><p>[C]</p></blockquote><ul><li>[c]<li>[C]</ul></div><div id=sidebar><div class=widget><h4>[b]</h4><p>[B]</p></div></div><div id=footer>[b] <a>[b]</a></div>",
    "<div class=cookie-notice role=alert><p>[B]</p><a>[b]</a></div><div class=page><div class=top-bar><a>[b]</a></div><div class=post><h1 class=post-title>[c]</h1><div class=post-body><p>[C]</p><div class=ad><p>[B]</p></div><p>[C]</p><p>[c]</p></div></div><div class=comments id=comments><h3>[b]</h3><div class=comment><p>[B]</p></div><div class=comment><p>[B]</p></div></div></div>",
    "<div class=breadcrumb><a>[b]</a> <a>[b]</a></div><section class=article-content><h1>[c]</h1><p>[C]</p><p>[C]</p><table><tr><td>[c]<td>[c]<tr><td>[c]<td>[c]</table></section><section class=related-posts><h2>[b]</h2><div><a>[b]</a><p>[B]</p></div></section><div class=newsletter><form><p>[B]</p></form></div>",
    "<table><tr><td class=menu><a>[b]</a><br><a>[b]</a></td><td class=main><h1>[c]</h1><p>[C]</p><p>[C]</p></td></tr></table><div class=copyright>[b]</div>",
    "<main role=main class=entry-content><h1>[c]</h1><p>[C]</p><aside class=promo><p>[B]</p></aside><p>[c]</p><figure><figcaption>[c]</figcaption></figure><p>[C]</p><div class=share><a>[b]</a><a>[b]</a></div></main><section id=disqus-thread class=responses><div class=reply><p>[B]</p></div><div class=reply><p>[B]</p></div></section><footer role=contentinfo><ul><li><a>[b]</a></ul></footer>",
    "<nav role=navigation><a>[b]</a><a>[b]</a></nav><div class=banner><p>[b]</p></div><article class=story><header><h1>[c]</h1></header><p>[C]</p><p>[C]</p><div class=advert sponsored>[B]</div><p>[c]</p><footer class=tags><a>[b]</a></footer></article><div class=gdpr consent popup><p>[B]</p></div>",
    "<div class=wrapper><div class=text><p>[C]</p><p>[C]</p><p>[c]</p><p>[C]</p></div><div class=links><ul><li><a>[b]</a><li><a>[b]</a><li><a>[b]</a></ul></div><div class=notice><p>[B]</p></div></div>",
)
_FILL = re.compile(r"\[([CcBb])\]")


# Names that sites give to blocks, each labelled by one small layout.
_MAIN_NAMES = "article blog body content entry main news post section story text".split()
_OTHER_NAMES = (
    "ad ads advert advertisement alert banner bar breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright "
    "discussion disqus feedback footer form gdpr header legal links login logo masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popular popup promo recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe tags toc toolbar top trending widget"
).split()


def layout_pages(copies: int = 4, seed: int = 1) -> list[tuple[list[Node], list[int]]]:
    """The labelled layouts, each filled with several lengths of text."""
    rng = random.Random(seed)

    def fill(m: re.Match) -> str:
        kind = m[1]
        n = rng.choice((8, 14, 25, 40, 80)) if kind.isupper() else rng.choice((1, 2, 3, 5))
        words = " ".join(f"w{rng.randrange(999)}" for _ in range(n))
        stop = "." if kind.isupper() or (kind == "c" and rng.random() < 0.5) else ""
        return ("\x01" if kind in "Cc" else "\x02") + words + stop

    small = [f"<div><div class={n}><p>[C]</p><p>[c]</p></div><p>[b]</p></div>" for n in _MAIN_NAMES]
    small += [f"<div><p>[c]</p><p>[C]</p><div class={n}><p>[B]</p><a>[b]</a></div></div>" for n in _OTHER_NAMES]
    out = []
    for layout in [*LAYOUTS, *small]:
        for _ in range(copies):
            nodes = parse("<html><body>" + _FILL.sub(fill, layout) + "</body></html>")
            content = [n.text[:1] == "\x01" for n in nodes]
            for n in nodes:
                n.text = n.text.replace("\x01", "").replace("\x02", "")
            out.append((nodes, _containers(nodes, content)))
    return out


def _containers(nodes: list[Node], content: list[bool]) -> list[int]:
    """States of all nodes from the labels of the text."""
    held = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == "#text":
            held[i][int(content[i])] += 1
        held[nodes[i].parent][0] += held[i][0]
        held[nodes[i].parent][1] += held[i][1]
    return [MIXED if all(h) else MAIN if h[1] else OTHER for h in held]


_OUT = frozenset("nav aside footer form header".split())
_OUT_NAMES = frozenset("ad ads advert advertisement banner comment comments cookie menu newsletter promo related share sidebar".split())


def markup_labels(nodes: list[Node]) -> list[int] | None:
    """Labels from a page's own markup, None unless it names exactly one article."""
    if sum(n.tag == "article" for n in nodes) != 1:
        return None
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i:
            inside[i] = (n.tag == "article" or inside[n.parent]) and n.tag not in _OUT and not _OUT_NAMES & set(n.names)
    return _containers(nodes, [s and n.tag == "#text" for s, n in zip(inside, nodes)])


def train(pages: list[str]) -> Model:
    model = Model()
    for nodes, content in layout_pages():
        model.learn(nodes, content)
    for i, page in enumerate(pages):
        nodes = parse(page)
        content = markup_labels(nodes)
        if content:
            model.learn(nodes, content, frozenset(["article"]) if i % 2 else frozenset())
    return model.finish()


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = parse(page)
    chance = model.marginals(nodes)
    return "\n".join(n.text for n, p in zip(nodes, chance) if n.tag == "#text" and n.text and p >= CONTENT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("page"))
    model = train(sorted(r["page"] for r in hash_sample(known, TRAIN_PAGES).collect()))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(p.as_py(), model) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars long")
