"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with the elements around them. A logistic classifier with fixed weights on a
block's surroundings (what its elements and their classes, ids and roles are called) and text (words, links, sentence
ends) gives its probability of being content; the two negative log-probabilities become capacities from the source and
to the sink. Every weight is moderate, so no single word decides: neighbouring blocks, and blocks next to each other
under the same parent, are joined by edges whose capacity grows with their closeness in the tree, and a few of these
outweigh a doubtful block. The minimum cut, found by maximum flow, separates content from boilerplate: a short line
between paragraphs of the article stays, and so does a paragraph whose class sounds like a widget, while a well-formed
sentence among the links of a menu goes.

Within a block character references are decoded and white space becomes one space; content blocks are
joined by line ends in page order. Nothing else is dropped or shortened.

Defined cases: null, empty and tag-free inputs (the last is one block of text) and unclosed or truncated
mark-up are read like any other page; pages of any length are read whole, in time that grows with their length; a
block that costs the same on either side goes with the sink; comments, scripts, styles, templates and the head are
never text; repeated rows give repeated rows; an empty table gives no rows; columns that are not asked for are not
read, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio

#: Elements whose content is no text of the page.
SKIPPED = ("script", "style", "noscript", "template", "title", "textarea", "select", "iframe", "svg", "math", "object", "canvas", "audio", "video", "head")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block of text.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an element of the same group ends, within the nearest of the containers.
ENDED_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in classes, ids and roles that speak against, and for, content.
AGAINST = frozenset("""ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices
alert popup modal overlay dialog sidebar aside rail widget widgets menu menus nav navbar navigation navigational breadcrumb breadcrumbs pagination pager header masthead topbar toolbar
footer bottombar copyright legal colophon contentinfo complementary comment comments commentlist disqus reply replies respond discussion reviews share sharing social related recommended recommendations
newsletter subscribe subscription signup signin login register search searchform form feedback poll teaser outbrain taboola skip hidden""".split())
LAYOUT = frozenset(("with", "without", "has", "no"))
FOR = frozenset("article content main post entry story body text prose hentry articlebody maincontent".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(" + "|".join(SKIPPED) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*[^>]*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    vote: float  # log odds of this element and those around it
    boiler: bool
    article: bool
    unseen: bool = False  # hidden, or controls of a form: never text of the article


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    heading: bool = False


#: Log odds: names and elements that speak against content, the first and each further one around a block; elements
#: and names for it; words of a block, the share of links, a sentence's end, a heading.
AGAINST_FIRST, AGAINST_MORE, FOR_ELEMENT, FOR_NAME = -5.0, -1.0, 3.0, 2.0
WORDS, LINKS, SENTENCE, HEADING, NEITHER = 0.6, -4.0, 0.6, 0.5, -0.6
#: Capacities: of neighbours of like surroundings or of one kind under one parent, of others, of the next under a parent.
NEAR, ACROSS, UNDER = 1.6, 0.15, 0.8


def _evidence(tag: str, attributes: str, parent: Node) -> tuple[float, bool, bool, bool]:
    vote, boiler, article, unseen = parent.vote, parent.boiler, parent.article, parent.unseen
    against = False
    if tag in ("article", "main"):
        vote, article = vote + FOR_ELEMENT, True
    elif tag in ("button", "fieldset", "form", "label"):
        unseen = against = True
    elif tag in ("nav", "aside", "menu", "dialog", "footer") or (tag == "header" and not article):
        against = True
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                words.update(PARTS.findall(CAMEL.sub(" ", value).lower()))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                unseen = against = True
        if words:
            # "with-sidebar" tells of a page's layout, and a header of the article holds its title.
            names = set() if words & LAYOUT else words & AGAINST
            if article and tag == "header" or words & FOR:
                names -= {"header"}
            if names:
                against = True
            elif words & FOR:
                vote, article = vote + FOR_NAME, article or bool(words & {"article", "main", "articlebody", "maincontent"})
    if against:
        # What is inside speaks for the article no longer.
        vote = min(vote, 0.0) + (AGAINST_MORE if boiler else AGAINST_FIRST)
    return vote, boiler or against, article, unseen


class _Open:
    """The open elements, with where those of each tag stand, so that a look-up doesn't walk the stack."""

    def __init__(self) -> None:
        self.root = Node("", None, 0, 0.0, False, False)
        self.stack = [self.root]
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]  # places of elements that are not inline
        self.links = 0

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.links += node.tag == "a"
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.of.get(t))), default=0)

    def cut(self, to: int) -> bool:
        """Closes all from place ``to`` on; whether one of them ends a block."""
        ends = self.blocks[-1] >= to
        for node in self.stack[to:]:
            self.of[node.tag].pop()
            self.links -= node.tag == "a"
        del self.stack[to:]
        while self.blocks[-1] >= to:
            self.blocks.pop()
        return ends


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text that are not empty, in page order."""
    open_, out = _Open(), []
    block = Block(open_.root)

    def flush() -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            out.append(block)
        block = Block(open_.root)

    def words(raw: str) -> None:
        if not block.parts:
            block.node = open_.stack[open_.blocks[-1]]
            block.heading = block.node.tag in HEADINGS
        text = html_lib.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if open_.links:
            block.linked += len(text)

    def close(to: int) -> None:
        if open_.blocks[-1] >= to:
            flush()
        open_.cut(to)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            words(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            place = open_.last(tag)
            # An inline element's end does not reach over a block's start.
            if place and (tag not in INLINE or place > open_.blocks[-1]):
                close(place)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            words(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            place = open_.last("p")
            if place and place == open_.blocks[-1]:
                close(place)
        elif tag in ENDED_BY:
            same = next((g for g in ({"dt", "dd"}, {"td", "th"}) if tag in g), {tag})
            place = open_.last(*same)
            if place > open_.last(*ENDED_BY[tag]):
                close(place)
        elif tag == "a" and open_.links:
            place = open_.last("a")
            if place > open_.blocks[-1]:
                close(place)
        if not (m[4] or "").endswith("/") or tag in INLINE:
            parent = open_.stack[-1]
            vote, boiler, article, unseen = _evidence(tag, m[4] or "", parent)
            open_.push(Node(tag, parent, parent.depth + 1, vote, boiler, article, unseen))
    if at < len(html):
        words(html[at:])
    flush()
    return out


def content_probability(block: Block) -> float:
    if block.node.unseen:
        return 1e-5
    n = len(block.text)
    share = min(1.0, block.linked / n)
    z = block.node.vote + NEITHER + WORDS * min(math.log1p(block.text.count(" ") + 1), 4.0) + LINKS * share
    z += SENTENCE * (block.text[-1] in ".!?。:;\"'»”)") + HEADING * block.heading
    if block.node.tag == "li" and share > 0.5:
        z -= 1.5
    return 1 / (1 + math.exp(-max(-12.0, min(12.0, z))))


def closeness(a: Node, b: Node) -> float:
    """Capacity of the edge between two blocks: large under one parent, small across the tree."""
    x, y, away = a, b, 0
    while x is not y and away < 40:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        away += 1
    alike = (a.boiler == b.boiler and a.article == b.article) or (a.tag == b.tag and a.parent is b.parent)
    return (NEAR if alike else ACROSS) / (1 + 0.5 * max(0, away - 2))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side: maximum flow by shortest augmenting levels (Dinic).

    source[i] is lost if node i goes to the sink's side, sink[i] if it stays.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i in range(n):
        through = min(source[i], sink[i])  # flows at once
        edge(s, i, source[i] - through, 0.0) if source[i] > through else edge(i, t, sink[i] - through, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    small = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in of[a]:
                if cap[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:
            path: list[int] = []
            a = s
            while a != t:
                while at[a] < len(of[a]):
                    e = of[a][at[a]]
                    if cap[e] > small and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def label(blocks: list[Block]) -> list[bool]:
    """Content or not, for each block."""
    if not blocks:
        return []
    p = [content_probability(b) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, closeness(blocks[i - 1].node, b.node)))
        parent = id(b.node.parent)
        if (j := last.get(parent)) is not None and j < i - 1:
            edges.append((j, i, UNDER * closeness(blocks[j].node, b.node)))
        last[parent] = i
    return minimum_cut([-math.log(max(1 - x, 1e-9)) for x in p], [-math.log(max(x, 1e-9)) for x in p], edges)


def extract(html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of pages, the extracted text and its length in code points."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textio.slices(batches, n):
            texts = [extract(h) for h in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return textio.map_batches(pages.select(*keep, F.col("html").alias("_html")), run, f"{kinds}, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(textio.table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
