"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node with two states, main text or not.  A node's
potential is how likely each state shows its tag, the words of its
class, id and role, the amount of its own text and its share of link text.  The
potential between parent and child is how likely a child of its kind of tag and of its
state is, given the parent's state.  Sum-product messages go from the leaves
up and from the root down; they are exact on a tree and give each node's
marginal.  All potentials are counted on labelled pages (``html_pages``), once
for each Python process, from a fixed seed.

The text of a page is that of the blocks whose element is more likely main
text than not, in page order.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_pages import pages

TRAINING_PAGES = 1500

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup and never text of the page.
RAW = frozenset("script style noscript template iframe svg object textarea".split())
#: Controls, whose text is never that of the page.
CONTROLS = frozenset("select button datalist optgroup option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt s samp small span strike strong sub sup time tt u var".split())
#: A start tag of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol table dl select td th html body article section div".split())


class Node:
    __slots__ = ("tag", "parent", "attrs", "own", "links")

    def __init__(self, tag: str, parent: int, attrs: str):
        self.tag, self.parent, self.attrs, self.own, self.links = tag, parent, attrs, 0, 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Elements in page order, and runs of text: (element of the block, pieces).  Time grows with the length of the page, whatever is in it."""
    nodes, blocks = [Node("#root", -1, "")], []
    stack, at, end = [0], 0, len(html)
    block, pieces, links = 0, [], 0
    # Depths of open elements: of the blocks, of those that bound or close list items and cells, and how many there are of each tag.
    outer, marks, opened = [0], [], defaultdict(int)
    last_end = html.rfind(">")

    def flush():
        nonlocal pieces
        if pieces:
            blocks.append((block, pieces))
            pieces = []

    def close(depth: int):
        nonlocal block, links
        while len(stack) > depth:
            n = nodes[stack.pop()]
            opened[n.tag] -= 1
            if marks and marks[-1] == len(stack):
                marks.pop()
            if n.tag == "a":
                links -= 1
            elif n.tag not in INLINE:
                flush()
                outer.pop()
                block = stack[outer[-1]]

    def text(s: str):
        if not s or s.isspace() and not pieces:
            return
        pieces.append(unescape(s) if "&" in s else s)
        size = len(s)
        nodes[block].own += size
        if links:
            nodes[block].links += size

    while at < end:
        # Behind the last > only a comment can begin.
        m = TOKEN.search(html, at, last_end + 1) if at <= last_end else None
        if not m:
            stop = html.find("<!--", at)
            text(html[at : stop if stop >= 0 else end])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if html.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            break
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if opened[name] > 0:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != name:
                    depth -= 1
                close(depth)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = stop.start() if stop else end
            if stop and (m := TOKEN.match(html, at)):
                at = m.end()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                text(" ")
            continue
        # All elements above the innermost block are inline.
        if name in CLOSES_P and nodes[block].tag == "p":
            close(outer[-1])
        if name in CLOSES_OWN:
            for depth in reversed(list(marks[-4:])):
                tag = nodes[stack[depth]].tag
                if tag in CLOSES_OWN[name]:
                    close(depth)
                    if tag not in ("td", "th") or name != "tr":
                        break
                elif tag in SCOPE:
                    break
        nodes.append(Node(name, stack[-1], m[3] or m[6] or ""))
        if name == "a":
            links += 1
        elif name not in INLINE:
            flush()
            block = len(nodes) - 1
            outer.append(len(stack))
        if name in SCOPE or name in CLOSES_OWN:
            marks.append(len(stack))
        opened[name] += 1
        stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


def observations(n: Node) -> list[str]:
    out = [f"n:{min(int(math.log2(n.own + 1)), 9)}"]
    if _kind(n.tag) in ("inline", "block"):
        out.append(f"t:{n.tag}")
    if n.own:
        out.append(f"l:{int(3.99 * min(1.0, n.links / n.own))}")
    if n.attrs:
        out += {f"w:{w}" for _, v in ATTRIBUTE.findall(n.attrs) for w in PART.findall(v.lower())}
    return out


def _kind(tag: str) -> str:
    return "inline" if tag in INLINE else tag if tag in ("head", "nav", "footer", "header", "aside", "form", "article", "main", "body", "html", "div", "section") else "block"


class Model:
    def __init__(self, n_pages: int = TRAINING_PAGES, seed: int = 1):
        seen: Counter = Counter()
        kinds: Counter = Counter()
        states: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        moves: dict[str, list[list[float]]] = defaultdict(lambda: [[0.5, 0.5], [0.5, 0.5]])
        for page in pages(n_pages, seed):
            html, labels = _written(page)
            nodes, _ = parse(html)
            for n, label in zip(nodes[1:], labels, strict=True):
                for o in observations(n):
                    states[o][label] += 1
                    seen[o[0], label] += 1
                kinds[n.tag] += 1
                moves[_kind(n.tag)][labels[n.parent - 1] if n.parent else 1][label] += 1
        #: For each observation, its likelihood in main text over that elsewhere.
        self.ratio = {o: (s[1] + 0.2) / (seen[o[0], 1] + 20) * (seen[o[0], 0] + 20) / (s[0] + 0.2) for o, s in states.items()}
        #: P(kind and state of a child | state of its parent), up to a factor for each kind.
        children = [sum(sum(m[state]) for m in moves.values()) for state in (0, 1)]
        self.moves = {k: [[x / n for x in row] for row, n in zip(m, children, strict=True)] for k, m in moves.items()}
        self.other = self.moves["block"]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(main text) of each node: messages up the tree, then down."""
        ratio, n = self.ratio, len(nodes)
        local, message, move = [1.0] * n, [(1.0, 1.0)] * n, [self.other] * n
        for i in range(1, n):
            x = 1.0
            for o in observations(nodes[i]):
                x *= ratio.get(o, 1.0)
            local[i] = x
            move[i] = self.moves.get(_kind(nodes[i].tag), self.other)
        # below[i]: odds of main text from the node and what is under it.
        below = local
        for i in range(n - 1, 0, -1):
            odds = min(max(below[i], 1e-30), 1e30)
            (a, b), (c, d) = move[i]
            m0, m1 = a + b * odds, c + d * odds
            message[i] = m0, m1
            below[nodes[i].parent] *= m1 / m0
            below[nodes[i].parent] = min(max(below[nodes[i].parent], 1e-60), 1e60)
        out = [1.0] * n
        for i in range(1, n):
            p = out[nodes[i].parent]
            m0, m1 = message[i]
            # The parent's marginal without this child's own message.
            w1, w0 = p / m1, (1 - p) / m0
            (a, b), (c, d) = move[i]
            odds = min(max(below[i], 1e-30), 1e30)
            on, off = (w0 * b + w1 * d) * odds, w0 * a + w1 * c
            out[i] = on / (on + off) if on + off else 0.0
        return out

    def extract(self, html: str) -> str:
        nodes, blocks = parse(html)
        p = self.marginals(nodes)
        for i, n in enumerate(nodes):
            if n.tag in CONTROLS or n.parent >= 0 and p[n.parent] < 0:
                p[i] = -1.0
        texts = (" ".join("".join(pieces).split()) for i, pieces in blocks if p[i] >= 0.5)
        return "\n".join(t for t in texts if t)


def _written(page: tuple) -> tuple[str, list[int]]:
    """HTML of a labelled page, and the labels of its elements in order."""
    out, labels = [], []

    def walk(node):
        if isinstance(node, str):
            out.append(node)
            return
        tag, attrs, children, content = node
        labels.append(int(content))
        out.append(f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">")
        for child in children:
            walk(child)
        out.append(f"</{tag}>")

    walk(page)
    return "".join(out), labels


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def extract(pages_df: DataFrame) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to page_id, url, html, ...; html is dropped.

    Null or empty html, or a page without main text: an empty text.  Other
    columns pass through, those with the names of added ones are replaced;
    repeated rows stay.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    df = pages_df.select(*(c for c in pages_df.columns if c.lower() not in ("text", "n_chars")))
    kept = [f for f in df.schema.fields if f.name != "html"]
    names = [f.name for f in kept]

    def run(batches):
        m = model()
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            for lo in range(0, batch.num_rows, 500):
                texts = [m.extract(x.as_py() or "") for x in html.slice(lo, 500)]
                own = [batch.column(batch.schema.get_field_index(c)).slice(lo, 500) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return df.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.col("text"), "n_chars")
