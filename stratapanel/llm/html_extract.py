"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks, split at block-level tags; script, style
and other unread elements hold no text.  A linear classifier over a block's
tags, class words, links and length gives the cost of calling it content or
boilerplate (an article resets weak class words of its wrappers, ids inside it
weigh little, a form around most of the prose does not count): the capacities from the source and to the sink.  Edges between
neighbouring blocks, and between siblings of one parent, make it cost to label
alike things differently.  The minimum cut is the cheapest labelling; blocks on
the source's side are the text.

Defined results: null or empty html gives an empty text; broken markup is read
as far as it goes (unclosed paragraphs, list items and cells end where the next
begins, stray end tags are ignored); null or repeated ids and urls are kept as
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
UNREAD = frozenset("script style noscript template title textarea iframe object svg math canvas audio video head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of its group begins, unless one of the stops lies between.
ENDS = {"li": ("li", "ul ol menu"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select")}
BOILER_TAGS = frozenset("nav footer aside button select menu dialog search fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar rail widget footer header masthead topbar toolbar share sharing social follow "
    "comment comments commentlist disqus respond reply replies discussion related recommended recommendations trending popular newsletter subscribe "
    "subscription signup login popup modal overlay paywall pager pagination copyright legal disclaimer search form".split())
#: Class words that count against an article or main element itself.
STRICT_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
#: Words that an id inside an article is still read for in full; other ids there are mostly anchors of its own sections.
ID_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments commentlist disqus respond share sharing social newsletter".split())
#: Class names that say what stands beside or is missing, not what the element is.
MODIFIER = re.compile(r"(?:has|with|without|no)[-_]", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_WORDS = frozenset("article content post entry story body text main".split())
#: Weights of the classifier, for the log-odds of content.
BIAS, IN_ARTICLE, PROSE_TAG, CONTENT_CLASS, BOILER_TAG, BOILER_CLASS, BOILER_ID, LINKED, LENGTH = -0.5, 4.0, 1.5, 1.5, -14.0, -12.0, -3.0, -5.0, 0.4
ADJACENT, SIBLING = 0.6, 0.8
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: A form with so many characters of prose, and half of the page's, is a wrapper of the page.
WRAPPED = 200
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    boiler_tag: bool = False
    boiler_class: bool = False  # by STRICT_WORDS
    weak_class: bool = False  # by other words; an article inside resets it
    boiler_id: bool = False
    form: Node | None = None
    article: bool = False
    content_class: bool = False


@dataclass
class TextBlock:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    node = Node(tag, parent)
    if parent:
        node.boiler_tag, node.boiler_class, node.article, node.content_class = parent.boiler_tag, parent.boiler_class, parent.article, parent.content_class
        node.weak_class, node.boiler_id, node.form = parent.weak_class, parent.boiler_id, parent.form
    if tag in ("article", "main"):
        node.weak_class &= node.article
        node.article = True
    elif tag == "form":
        node.form = node.form or node
    elif tag in BOILER_TAGS or tag == "header" and not node.article:
        node.boiler_tag = True
    if attributes and tag not in ("html", "body"):
        for name, value, hidden in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                own = " ".join(x for x in value.split() if not MODIFIER.match(x))
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", own).lower()))
                if name == "id" and tag in HEADINGS:
                    pass
                elif name == "id" and node.article and tag not in ("article", "main"):
                    node.boiler_class |= bool(words & ID_WORDS)
                    node.boiler_id |= bool(words & BOILER_WORDS)
                else:
                    node.boiler_class |= bool(words & STRICT_WORDS)
                    node.weak_class |= tag not in ("article", "main", "form") and bool(words & BOILER_WORDS)
                node.content_class |= bool(words & CONTENT_WORDS)
            elif name == "role":
                node.boiler_tag |= value.lower() in BOILER_ROLES
                node.article |= value.lower() in ("main", "article")
            elif hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                node.boiler_tag = True
    return node


def blocks(page: str) -> list[TextBlock]:
    """Text blocks in page order; white space is one space, character references are decoded."""
    root = Node("", None)
    stack, found, current, unread, links, at = [root], [], None, 0, 0, 0

    def close(k: int) -> None:
        nonlocal unread, links
        for node in stack[k:]:
            unread -= node.tag in UNREAD
            links -= node.tag == "a"
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal current
        if unread or not raw:
            return
        if current is None:
            if not raw.strip():
                return
            current = TextBlock(next(n for n in reversed(stack) if n.tag in BLOCK or n is root))
            found.append(current)
        current.parts.append(raw)
        current.linked += len(raw) if links else 0

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            current = None
        elif tag == "br":
            say(" ")
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCK), 0)
            if stack[k].tag == "p":  # a paragraph holds no blocks
                close(k)
        if tag in ENDS:
            same, stops = (x.split() for x in ENDS[tag])
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in same or stack[k].tag in stops), 0)
            if k and stack[k].tag in same:
                close(k)
        elif tag == "body":
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "head"), 0)
            if k:
                close(k)
        stack.append(_node(tag, m[3], stack[-1]))
        unread += tag in UNREAD
        links += tag == "a"
    for b in found:
        b.text = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
    found = [b for b in found if b.text]
    prose = lambda b: len(b.text) if b.node.tag in PROSE and not b.linked else 0
    total, inside = 0, {}
    for b in found:
        total += prose(b)
        inside[id(b.node.form)] = inside.get(id(b.node.form), 0) + prose(b)
    for b in found:
        if b.node.form and inside[id(b.node.form)] < max(WRAPPED, total / 2):
            b.node.boiler_tag = True
    return found


def odds(block: TextBlock) -> float:
    """Log-odds that a block is content."""
    n, length = block.node, sum(map(len, block.parts))
    return (BIAS + IN_ARTICLE * n.article + PROSE_TAG * (n.tag in PROSE) + CONTENT_CLASS * n.content_class + BOILER_TAG * n.boiler_tag
            + BOILER_CLASS * (n.boiler_class or n.weak_class) + BOILER_ID * n.boiler_id + LINKED * block.linked / max(length, 1) + LENGTH * math.log1p(len(block.text)) / 2)


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source; ``gain`` > 0 ties a node to the source, < 0 to the sink."""
    n = len(gain)
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, to: float, back: float) -> None:
        graph[a].append([b, to, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for k, g in enumerate(gain):
        if g > 0:
            edge(n, k, g, 0.0)
        else:
            edge(k, n + 1, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level, queue = {n: 0}, [n]
        for a in queue:
            for b, free, _ in graph[a]:
                if free > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if n + 1 not in level:
            return [k in level for k in range(n)]
        turn, path = [0] * (n + 2), []
        a = n
        while True:  # blocking flow, without recursion
            if a == n + 1:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                a, path = n, []
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if e[1] > 1e-9 and level.get(e[0]) == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == n:
                    break
                back = path.pop()
                a = graph[back[0]][back[2]][0]
                turn[a] += 1
                continue
            path.append(e)
            a = e[0]


def content(page: str | None) -> list[str]:
    """Content blocks of a page, in order."""
    row = blocks(page or "")
    if not row:
        return []
    edges, last = [], {}
    for k, b in enumerate(row):
        if k:
            edges.append((k - 1, k, ADJACENT))
        parent = id(b.node.parent)
        if parent in last:
            edges.append((last[parent], k, SIBLING))
        last[parent] = k
    kept = minimum_cut([odds(b) for b in row], edges)
    return [b.text for b, keep in zip(row, kept) if keep]


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text: the content blocks joined by line feeds."""

    def run(batches):
        for part in slices(batches, "html"):
            texts = ["\n".join(content(h)) for h in column(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), "url", F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string")
