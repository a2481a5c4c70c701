"""Main-text extraction with a tree-structured graphical model over the DOM.

Each block element and each run of text beside blocks is a node with a hidden
label: *content* (it is, or holds, main text) or *boilerplate* (its whole
subtree is).  Unary potentials come from the node's own features (tag, parent's
tag, class and id words, text length, share of linked text, punctuation);
parent-child potentials from how often labels follow each other down the tree.
Both are counted on labelled pages.  Sum-product messages pass once upward and
once downward, which gives exact marginals on a tree; text of nodes whose
content marginal is at least ``THRESHOLD`` is kept, in page order.

Scripts, styles, templates, form controls, comments and the head hold no text
for readers and are dropped while parsing.  Tags may be left open: blocks close
an open paragraph, items close items, and an end tag closes what is open inside.

Inside a block, white space (line breaks and <br> too) becomes one space and
character references are decoded; blocks are joined by a blank line.

Pages are judged one by one in an Arrow map without a shuffle; the model is a
small table of fixed size.  Defined cases: null counts as empty; a page without
content gives an empty text; text without any markup is one block; repeated
rows give a row each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_pages
from .scratch import lean, small_batches

THRESHOLD = 0.5
#: Element kinds.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title iframe noscript template svg select button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WRAPPERS = set("#page html body div main form center td".split())
LISTS = {"ul", "ol", "dl", "table", "menu"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r'data-label="([01])"')
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    label: int = -1
    text: list[str] = field(default_factory=list)
    linked: int = 0
    holds: bool = False  # block children


def parse(page: str) -> list[Node]:
    """Nodes in page order; a parent stands before its children."""
    nodes = [Node("#page", -1)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with their node; inline ones share their block's
    run = -1  # the open text run of a node that also holds blocks
    links, at, n = 0, 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            owner = stack[-1][1]
            if run < 0 and (piece.isspace()):
                if nodes[owner].text:
                    nodes[owner].text.append(" ")
                continue
            if run < 0:
                run = len(nodes)
                nodes.append(Node("#text", owner))
            nodes[run].text.append(html.unescape(piece))
            if links:
                nodes[run].linked += len(piece)
            continue
        tag, close, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                links -= sum(t == "a" for t, _ in stack[depth:])
                if tag not in INLINE:
                    run = -1
                elif any(t not in INLINE for t, _ in stack[depth:]):
                    links += sum(t == "a" for t, _ in stack[depth:])
                    continue  # an inline end tag does not close blocks
                del stack[depth:]
            elif tag == "p":
                run = -1
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else n
                continue
        if tag == "br" or tag in INLINE and tag in VOID:
            if run >= 0:
                nodes[run].text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                run = -1
            continue
        if tag in INLINE:
            if not attributes.endswith("/"):
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        run = -1
        if tag in CLOSES_P:
            _close_open(stack, {"p"}, CLOSES_P - {"p"})
        if tag in SAME:
            _close_open(stack, SAME[tag], LISTS)
        links = sum(t == "a" for t, _ in stack)
        if attributes.endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        label = _LABEL.search(attributes) if "data-label" in attributes else None
        nodes.append(Node(tag, stack[-1][1], names, int(label[1]) if label else -1))
        nodes[stack[-1][1]].holds = True
        stack.append((tag, len(nodes) - 1))
    return nodes


def _close_open(stack: list[tuple[str, int]], tags: set[str], barrier: set[str]) -> None:
    """Close the innermost open element of ``tags`` that no barrier hides."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            del stack[k:]
            return
        if stack[k][0] in barrier:
            return


def node_features(nodes: list[Node]) -> list[list[str]]:
    """Own features of each node, as strings."""
    chars, linked = [0] * len(nodes), [0] * len(nodes)
    marks = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.text:
            text = "".join(node.text)
            chars[i] += len(text)
            linked[i] += node.linked
            marks[i] += sum(map(text.count, ".,;!?"))
        if node.parent >= 0:
            chars[node.parent] += chars[i]
            linked[node.parent] += linked[i]
            marks[node.parent] += marks[i]
    out = []
    for i, node in enumerate(nodes):
        above = nodes[node.parent].tag if node.parent >= 0 else "-"
        if node.tag == "#text" and not nodes[node.parent].holds:
            out.append([])  # its block has the same features
            continue
        found = [f"tag={node.tag}", f"above={above}/{'text' if node.tag == '#text' else 'block'}"]
        if chars[i]:
            found.append(f"links={min(4, int(5 * linked[i] / chars[i]))}")
            found.append(f"length={min(5, int(math.log2(chars[i] + 1) / 2))}{'t' if node.tag == '#text' else ''}")
            found.append(f"marks={min(2, marks[i])}")
        for name in {x.lower() for x in _SPLIT.findall(node.names)}:
            found.append(f"name={name}")
        out.append(found)
    return out


def _relation(nodes: list[Node], node: Node) -> str:
    """Which parent-child potential holds between a node and its parent."""
    if node.tag == "#text":
        return "text"
    return "wrapped" if node.parent < 0 or nodes[node.parent].tag in WRAPPERS else "inner"


class Model:
    """Log odds of features and parent-child probabilities."""

    def __init__(self, pages: Iterable[str], smooth: float = 0.5):
        counts = Counter(), Counter()
        totals = [0, 0]
        pairs = {k: [[4 * smooth, smooth], [smooth, smooth]] for k in ("text", "wrapped", "inner")}
        for page in pages:
            nodes = parse(page)
            for i, (node, found) in enumerate(zip(nodes, node_features(nodes))):
                if node.label < 0:
                    node.label = nodes[node.parent].label if node.tag == "#text" else 1
                totals[node.label] += 1
                counts[node.label].update(found)
                if i:
                    pairs[_relation(nodes, node)][nodes[node.parent].label][node.label] += 1
        self.odds = {f: math.log((counts[1][f] + smooth) / (totals[1] + 2 * smooth)) - math.log((counts[0][f] + smooth) / (totals[0] + 2 * smooth)) for f in counts[0] | counts[1]}
        self.pairs = {k: [[x / sum(row) for x in row] for row in rows] for k, rows in pairs.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node, by sum-product."""
        n = len(nodes)
        tables = [self.pairs[_relation(nodes, node)] for node in nodes]
        up = []
        for found in node_features(nodes):
            x = max(-30.0, min(30.0, sum(self.odds.get(f, 0.0) for f in found)))
            up.append([1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))])
        message = [[1.0, 1.0] for _ in range(n)]
        for i in range(n - 1, 0, -1):  # children stand after their parents
            b, pairs = up[i], tables[i]
            m = [pairs[k][0] * b[0] + pairs[k][1] * b[1] for k in (0, 1)]
            total = m[0] + m[1]
            message[i] = [m[0] / total, m[1] / total]
            above = up[nodes[i].parent]
            above[0] *= message[i][0]
            above[1] *= message[i][1]
            total = above[0] + above[1]
            if total < 1e-200:
                above[0], above[1] = above[0] * 1e200, above[1] * 1e200
        out = [0.0] * n
        belief = [[0.0, 0.0]] * n
        for i in range(n):
            if i:
                above, mine, pairs = belief[nodes[i].parent], message[i], tables[i]
                rest = [above[k] / max(mine[k], 1e-300) for k in (0, 1)]  # all but this child
                b = [up[i][k] * (rest[0] * pairs[0][k] + rest[1] * pairs[1][k]) for k in (0, 1)]
            else:
                b = [0.0, up[0][1]]  # the page as a whole holds content
            total = b[0] + b[1] or 1.0
            belief[i] = [b[0] / total, b[1] / total]
            out[i] = belief[i][1]
        return out


def main_text(page: str, model: Model, threshold: float = THRESHOLD) -> str:
    nodes = parse(page)
    blocks = []
    for node, p in zip(nodes, model.marginals(nodes)):
        if p >= threshold and node.text:
            block = " ".join("".join(node.text).split())
            if block:
                blocks.append(block)
    return "\n\n".join(blocks)


def fit(pages: Iterable[str] | None = None) -> Model:
    """Train on labelled pages (elements with ``data-label``)."""
    return Model(labelled_pages() if pages is None else pages)


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py() or "", shared.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
