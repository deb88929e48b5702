"""HTML extraction by tag-path ratios.

Every text node has a path of tags from the root. Per path, text length and punctuation are
summed over its nodes; the ratio of text to nodes and the ratio of text to punctuation-weighted
spread are smoothed over the paths in page order and fused, and the paths above the threshold
select the content nodes. The lowest block that holds the selected nodes is the article; its text is
kept in page order. Parts of the kinds that an article goes without (menus, headers, footers, sidebars, forms,
notices, adverts, comments) are marked by tag, role or class name; their paths are worth DEMERIT of their
ratio, and inside the article they go unless their path is selected all the same. Elements nest as deep as
they do in the page, and a page takes time in proportion to its length.

White space is what Python's ``\\s`` matches. Null and empty pages, and pages whose text is all marked, give an
empty text. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read

# Possessive pieces, so that no text is gone over twice.
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s/]|$)|aria-hidden\s*+=\s*+["']?true|style\s*+=\s*+["'][^"']*?display\s*+:\s*+none)""", re.I)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、]")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
#: What a browser does not show as text of the page.
UNSEEN = RAW | frozenset("head select option datalist svg canvas object audio video".split())
#: Menus, headers (outside of articles), footers, sidebars, forms and notices by tag.
MARKED = frozenset("nav footer aside form button menu dialog fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
#: Elements whose end tag may be left out: what a start tag closes, and what it does not reach across.
SELF_CLOSING = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words in class and id names of parts that are no content, and words that may stand beside them.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb"
    " breadcrumbs header masthead footer foot comment comments reply replies respond disqus cookie cookies consent notice notices gdpr alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright legal disclaimer"
    " contentinfo complementary search skip".split()
)
NEUTRAL = frozenset(
    "a b c js site page top bottom left right main block box section container wrapper wrap area bar list item items inner outer group panel content body links link"
    " text row col column region slot unit module component the of to and my user reader form buttons button thread primary secondary global local mobile desktop".split()
)
WORD = re.compile(r"[a-z]+")
#: What the fused ratio of a marked part is multiplied by.
DEMERIT = 0.001


class Node:
    """An element. ``path`` numbers its tags from the root together with whether it is marked."""

    __slots__ = ("tag", "parent", "unseen", "marked", "article", "path", "depth", "at")

    def __init__(self, tag: str, parent: "Node | None", unseen: bool, marked: bool, paths: dict, at: int):
        self.tag, self.parent, self.at = tag, parent, at
        self.unseen, self.marked = unseen or bool(parent and parent.unseen), marked or bool(parent and parent.marked)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.depth = parent.depth + 1 if parent else 0
        self.path = paths.setdefault((parent.path if parent else -1, tag, self.marked), len(paths))


def is_marked(tag: str, attrs: str, parent: Node) -> bool:
    """Whether an element is of a kind that the article goes without: by tag, role or all of a class name's words."""
    if tag in MARKED or tag == "header" and not parent.article or attrs and HIDDEN.search(attrs):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for m in ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        for name in value.split():
            words = WORD.findall(name)
            if any(w in BOILER for w in words) and all(w in BOILER or w in NEUTRAL for w in words):
                return True
    return False


class Stack:
    """The open elements, and where each tag and the last block stand, so that nothing is searched for."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from place ``at`` on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def text_nodes(page: str) -> tuple[list[tuple[Node, int, str]], list[Node]]:
    """The text nodes in page order (element, number of the run of text without a block border, text), and all
    elements, parents first. Every character is looked at a bounded number of times."""
    paths: dict = {}
    root = Node("", None, False, False, paths, 0)
    out, elements, stack, run, at = [], [root], Stack(root), 0, 0

    def add(text: str) -> None:
        if text:
            out.append((stack.nodes[-1], run, text))

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = NAME.match(page, lt + 1)
        if not m:
            if page.startswith("<!--", lt):
                end, n = page.find("-->", lt + 4), 3
            elif page.startswith(("<!", "<?", "</"), lt):
                end, n = page.find(">", lt), 1
            else:  # a plain sign
                add(page[at : lt + 1])
                at = lt + 1
                continue
            add(page[at:lt])
            at = end + n if end >= 0 else len(page)
            continue
        add(page[at:lt])
        end = ATTRIBUTES.match(page, m.end()).end()
        if end < len(page) and page[end] != ">":  # a quote that never ends
            end = page.find(">", m.end())
            end = end if end >= 0 else len(page)
        attrs, at, tag = page[m.end() : end], end + 1, m[1].lower()
        if tag in BLOCK:
            run += 1
        if page[lt + 1] == "/":
            if stack.places.get(tag):
                stack.cut(stack.places[tag][-1])
            continue
        if tag in CLOSES_P and stack.blocks and stack.nodes[stack.blocks[-1]].tag == "p":
            stack.cut(stack.blocks[-1])
        if tag in SELF_CLOSING:
            closed, across = SELF_CLOSING[tag]
            if (place := stack.last(closed)) > stack.last(across):
                stack.cut(place)
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        parent = stack.nodes[-1]
        node = Node(tag, parent, tag in UNSEEN, is_marked(tag, attrs, parent), paths, len(elements))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
        if not attrs.endswith("/") or tag in BLOCK:
            elements.append(node)
            stack.push(node)
    return out, elements


def smoothed(x: list[float]) -> list[float]:
    """A Gaussian window of two on either side."""
    w = [math.exp(-(k * k) / 2) for k in range(-2, 3)]
    out = []
    for i in range(len(x)):
        parts = [(w[k + 2], x[i + k]) for k in range(-2, 3) if 0 <= i + k < len(x)]
        out.append(sum(a * b for a, b in parts) / sum(a for a, _ in parts))
    return out


def path_weights(nodes: list[tuple[int, str]], marked: frozenset[int] | set[int] = frozenset()) -> tuple[dict[int, float], float]:
    """The fused ratio of each path, and the threshold, of (path, text) in page order. Paths in ``marked`` are
    worth DEMERIT of theirs."""
    stats: dict[int, list[list[int]]] = {}
    for path, text in nodes:
        s = stats.setdefault(path, [[], []])
        s[0].append(len(text))
        s[1].append(len(PUNCTUATION.findall(text)))

    def spread(v: list[int]) -> float:
        mean = sum(v) / len(v)
        return math.sqrt(sum((a - mean) ** 2 for a in v) / len(v))

    paths = list(stats)
    length = smoothed([sum(stats[p][0]) / len(stats[p][0]) for p in paths])
    marks = smoothed([(sum(stats[p][1]) + 1) / len(stats[p][1]) * (1 + math.log1p(spread(stats[p][0])) + math.log1p(spread(stats[p][1]))) for p in paths])
    # A path's own text counts as well as that of its neighbours in the page.
    fused = [a * b * sum(stats[p][0]) * (DEMERIT if p in marked else 1) for a, b, p in zip(length, marks, paths, strict=True)]
    mean = sum(fused) / len(fused)
    return dict(zip(paths, fused, strict=True)), min(math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(fused))


LINES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td th tr tbody table dd dt dl".split())


def content_block(chosen: list[Node], elements: list[Node]) -> Node:
    """The lowest block that holds all chosen elements; where it is only a paragraph or the like, its container,
    and inside an article the whole article."""
    below = [0] * len(elements)
    for n in chosen:
        below[n.at] += 1
    for n in reversed(elements[1:]):
        below[n.parent.at] += below[n.at]
    top = max((n for n in elements if below[n.at] == len(chosen)), key=lambda n: n.depth)
    while top.parent and (top.tag not in BLOCK or top.tag in LINES):
        top = top.parent
    near = top
    while near.parent and near.tag not in ("article", "main"):
        near = near.parent
    return near if near.parent else top


def extract(page: str) -> str:
    """The main text of a page: its blocks, each in one line."""
    nodes, elements = text_nodes(page)
    seen = [(n, run, SPACE.sub(" ", entities.unescape(t))) for n, run, t in nodes if not n.unseen]
    ranked = [(n, t) for n, _, t in seen if t.strip()]
    if all(n.marked for n, _ in ranked):
        return ""
    weight, threshold = path_weights([(n.path, t.strip()) for n, t in ranked], {n.path for n, _ in ranked if n.marked})
    top = content_block([n for n, _ in ranked if weight[n.path] >= threshold], elements)
    inside = [False] * len(elements)
    for n in elements:
        inside[n.at] = n is top or bool(n.parent and inside[n.parent.at])
    blocks: dict[int, list[str]] = {}
    for n, run, t in seen:
        if inside[n.at] and (not n.marked or weight.get(n.path, 0) >= threshold):
            blocks.setdefault(run, []).append(t)
    out = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(b for b in out if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""

    def make():
        def f(ids, urls, htmls):
            texts = [extract(h or "") for h in htmls]
            return ids, urls, texts, [len(t) for t in texts]

        return f

    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_rows(src, ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint", make)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
