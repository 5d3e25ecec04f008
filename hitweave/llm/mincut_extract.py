"""Main text of web pages by minimum cut.

A page becomes its text blocks in order. A linear classifier on each block's place, words
and links gives it a cost for either label: the capacity of its edge to the source
(content) or to the sink (boilerplate). Smoothness edges join blocks that follow each other
and blocks that follow each other inside one container, the stronger the closer they are in
the DOM. A maximum flow then separates content from the rest at least total cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raw elements reach up to their end tag or the end of the page. Silent ones are left out whole where they
# have an end tag and no element of their own kind inside; the others go on as open elements (see blocks_of).
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe|title)\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+"
    r"(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<silent>noscript|template|select|button|object|canvas|svg)\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+"
    r">[^<]*+(?:<(?!/?(?P=silent)\b)[^<]*+)*+</(?P=silent)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements of the values end where an element of the key begins.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}}
CLOSES |= {"td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CLOSES |= {tag: {"p"} for tag in BLOCK - set(CLOSES) - {"html", "body"}}
#: An implied end does not reach beyond these.
SCOPE = set("html body table td th ul ol dl div article section main nav aside header footer form blockquote".split())
SILENT = set("noscript template select button object canvas svg".split())
#: Silent elements that can hold blocks; the others end where a block begins.
HOLDS_BLOCKS = {"noscript", "template", "object", "canvas"}
CONTENT_TAGS = {"article", "main"}
OTHER_TAGS = set("nav footer aside form menu dialog fieldset".split())
CONTENT_HINTS = {"article", "content", "main", "post", "story", "entry", "body"}
OTHER_HINTS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie "
    "cookies copyright dialog disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

# Weights of the classifier; positive is for content.
W_BIAS, W_WORDS, W_SENTENCE, W_LINKS = -1.5, 0.6, 0.5, -3.0
W_CONTENT_TAG, W_CONTENT_HINT, W_OTHER, W_HEADING = 4.0, 1.5, -7.0, 0.5
# Smoothness: blocks next to each other, and next to each other in a container; halved for each step up the DOM.
S_NEXT, S_CONTAINER = 0.4, 1.2


@dataclass(slots=True)
class Node:
    tag: str
    depth: int
    inside: int  # 1 in content tags, adds up with hints
    other: bool  # in a part that is boilerplate by its tag
    marked: bool  # or by a hint since the last content tag
    hinted: bool
    parent: "Node | None"


@dataclass(slots=True)
class Block:
    text: str
    links: int
    node: Node


def _hints(attrs: str) -> set[str]:
    return {part.lower() for groups in HINT.findall(attrs) for part in PART.findall("".join(groups))}


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: references decoded, white space as one space, empty ones left out.

    A silent element without its end tag ends with the element around it, and one that cannot
    hold blocks also where a block begins.
    """
    node = Node("", 0, 0, False, False, False, None)
    out: list[Block] = []
    parts: list[str] = []
    links = [0, 0]  # open <a>, characters in links
    silent: list[tuple[str, int]] = []  # open silent elements and the depth they are at

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, links[1], node))
        parts.clear()
        links[1] = 0

    for token in TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            if not silent:
                parts.append(text)
                links[1] += len(text) if links[0] else 0
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links[0] = 0 if token["close"] else 1
        elif tag in SILENT:
            if not token["close"]:
                silent.append((tag, node.depth))
            elif tag in [name for name, _ in silent]:
                while silent.pop()[0] != tag:
                    pass
        elif tag in BLOCK:
            flush()
            if token["close"]:
                up = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    node = up.parent
                    silent = [x for x in silent if x[1] <= node.depth]
            elif tag not in VOID:
                up, ends = node, CLOSES.get(tag, ())
                while up.parent is not None and (up.tag in ends or up.tag not in SCOPE):
                    if up.tag in ends:
                        node = up.parent
                    up = up.parent
                silent = [x for x in silent if x[1] <= node.depth and x[0] in HOLDS_BLOCKS]
                attrs = token["attrs"]
                hints = _hints(attrs) if "=" in attrs else ()
                inside = node.inside + (tag in CONTENT_TAGS)
                other = node.other or tag in OTHER_TAGS or tag == "header" and not inside
                marked = node.marked and tag not in CONTENT_TAGS
                marked = marked or bool(hints) and not OTHER_HINTS.isdisjoint(hints) and tag not in ("html", "body")
                hinted = node.hinted or bool(hints) and not CONTENT_HINTS.isdisjoint(hints)
                node = Node(tag, node.depth + 1, inside, other, marked, hinted, node)
    flush()
    return out


def block_score(block: Block) -> float:
    """Evidence for content, in units of cost."""
    node, words = block.node, block.text.count(" ") + 1
    score = W_BIAS + W_WORDS * math.log(1 + words) + W_LINKS * min(1.0, block.links / len(block.text))
    if block.text[-1] in ".!?…\"”":
        score += W_SENTENCE
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += W_HEADING
    if node.other or node.marked:
        return score + W_OTHER
    if node.inside:
        return score + W_CONTENT_TAG
    return score + W_CONTENT_HINT if node.hinted else score


def _steps(a: Node, b: Node) -> int:
    """Steps up from both blocks to their common container."""
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a, n = a.parent, n + 1
        else:
            b, n = b.parent, n + 1
    return n


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, later block, weight) of the edges; at most two for each block."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = S_NEXT * 2.0 ** -min(30, _steps(blocks[i - 1].node, block.node))
        container = block.node.parent or block.node
        before = last.get(id(container))
        if before is not None:
            edges[before, i] = edges.get((before, i), 0.0) + S_CONTAINER
        last[id(container)] = i
    return [(a, b, w) for (a, b), w in edges.items()]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are on the source side of a minimum cut (the smallest such side)."""
    n = len(scores)
    if not n or min(scores) > 0 or max(scores) <= 0:
        return [s > 0 for s in scores]
    source, sink = n, n + 1
    heads, room, out = [], [], [[] for _ in range(n + 2)]

    def connect(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(heads))
        out[b].append(len(heads) + 1)
        heads.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0.0)
        elif s < 0:
            connect(i, sink, -s, 0.0)
    for a, b, w in edges:
        connect(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[heads[e]] < 0:
                    level[heads[e]] = level[a] + 1
                    queue.append(heads[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # all shortest ways that still have room, depth first
            if a == sink:
                flow = min(room[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= tiny:
                        cut = min(cut, k)
                a = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > tiny and level[heads[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = heads[path[-1]]
            elif path:
                a = heads[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    content = minimum_cut([block_score(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, content) if keep)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``_main``, the main text of each row's whole page; null and empty pages have the empty text.

    A column ``_main`` of the input gives way; repeated rows are extracted each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(p.as_py()) for p in batch.column("_page")], pa.string())
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_page"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), found], [*(n for n, _ in kept), "_main"])

    pages = pages.drop("_main", "_page")
    schema = pages.withColumn("_main", F.lit("")).schema
    return pages.withColumn("_page", F.col(page)).mapInArrow(run, schema)
