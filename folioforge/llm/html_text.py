"""Operator 1: main text of HTML pages by minimum-cut labelling.

A page is read by a forgiving tokenizer into blocks of text with their place in the element
tree. A logistic classifier, fitted to made pages whose main text is known (html_training),
gives each block its log-odds of being boilerplate from the elements around it, their names,
its links, length and punctuation; these are its terminal capacities. Neighbouring blocks and
blocks that are near in the tree are joined by smoothness edges, whose capacities are chosen
on made pages too, so that they are on the same scale. The minimum cut of that graph (a
maximum flow) separates the content, whose blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import prepare, table

SEPARATOR = "\n\n"
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("head noscript template svg select button option canvas object embed audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table"))}
#: What an open p isn't looked for outside of: by a block that begins, and by its end tag.
ENDS_P = ("article", "section", "body", "main", "table", "form", "div")
ENDS_END_P = ("div", "article", "section", "body", "main", "td", "li")

#: Evidence that an element gives to the text in it.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar".split())
NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|side-?bars?|foot(?:er)?|masthead|bread-?crumbs?|ads?|adverts?|advertisements?|advertising|banners?|promos?|promotions?|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modals?|overlay|news-?letters?|subscri\w+|sign-?up|social|share|sharing|comments?|commentlist|disqus|widgets?|pagination|pager|tool-?bars?|log-?in|tag-?cloud|related[_-]?(?:posts?|articles?|links?|stories|content|news|items|reading|topics)|recommend\w*|popular|trending|reply|replies|respond)(?=$|[\s_-])",
    re.I,
)
#: Names that parts of an article have as well.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:related|legal|copyright|search\w*|skip\w*|toc)(?=$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:headers?|top-?bar)(?=$|[\s_-])", re.I)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose)(?=$|[\s_-])", re.I)
ENDINGS = tuple(".!?…。:;\"'”»)")
NOTICE_TEXT = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b|all rights reserved)|\b(?:we use cookies|accept (?:all )?cookies|subscribe to|sign up for|privacy policy|terms of (?:use|service))\b", re.I)
#: Of a block, in this order: whether it lies in a boilerplate element; in one by its name; in a header outside an article; in
#: an element with a doubtful name; in an article; in an element with a content name; the share of its text in links, and that in a
#: list; its length; whether it ends like a sentence; is a heading; is worded as a notice.
FEATURES = ("constant", "element", "name", "header", "doubtful", "article", "content", "links", "listed_links", "length", "ending", "heading", "notice")


@dataclass
class Open:
    """An open element, and what the elements around it say; block is the innermost element that makes a block, depth how many do."""

    tag: str
    above: Open | None
    depth: int = 0
    block: Open | None = None
    dropped: bool = False
    in_link: bool = False
    in_article: bool = False
    heading: bool = False
    listed: bool = False
    element: bool = False
    name: bool = False
    header: bool = False
    doubtful: bool = False
    content: bool = False


def _root() -> Open:
    root = Open("", None)
    root.block = root
    return root


@dataclass
class Block:
    pieces: list[str]
    at: Open
    link_chars: int = 0
    text: str = ""


@dataclass
class Reader:
    """Builds blocks from a page's tags and text."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Open] = field(default_factory=lambda: [_root()])
    run: Block | None = None
    #: Where the stack has each open tag.
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))

    def last(self, tags) -> int:
        """The innermost place of any of these tags; -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, at: int) -> None:
        for o in self.stack[at:]:
            self.places[o.tag].pop()
        del self.stack[at:]

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if top.dropped or not data:
            return
        if self.run is None:
            self.run = Block([], top)
        self.run.pieces.append(data)
        if top.in_link:
            self.run.link_chars += len(data)

    def boundary(self) -> None:
        if self.run is not None:
            self.run.text = " ".join(html.unescape("".join(self.run.pieces)).split())
            if self.run.text:
                self.blocks.append(self.run)
            self.run = None

    def close_to(self, tag: str, within: tuple[str, ...]) -> None:
        """Closes the innermost such element that isn't outside one of `within`."""
        own = ("td", "th") if tag == "td" else ("dd", "dt") if tag in ("dd", "dt") else (tag,)
        at = self.last(own)
        if at > self.last((*within, *ENDS_P) if tag == "p" else within):
            self.cut(at)

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            elif tag == "hr":
                self.boundary()
            return
        if tag in BLOCK:
            self.boundary()
            if tag in CLOSES_P:
                self.close_to("p", ("button",))
            if tag in CLOSES:
                self.close_to(*CLOSES[tag])
        if closed and tag not in BLOCK:
            return
        above = self.stack[-1]
        own = Open(tag, above, above.depth + (tag in BLOCK), above.block, above.dropped or tag in HIDDEN, above.in_link or tag == "a", above.in_article or tag in ("article", "main"))
        if tag in BLOCK:
            own.block = own
        own.heading = above.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        own.listed = tag in ("li", "dt", "dd") or (above.listed and tag not in BLOCK)
        own.element = above.element or tag in BOILERPLATE_TAGS
        own.name, own.doubtful, own.content = above.name, above.doubtful, above.content
        own.header = above.header or (tag == "header" and not above.in_article)
        if attributes and not own.dropped:
            told = {}
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                told.setdefault(name.lower(), a or b or c)
            style = told.get("style", "").replace(" ", "").lower()
            if "hidden" in told or told.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
                own.dropped = True
            role = told.get("role", "").lower()
            own.element |= role in BOILERPLATE_ROLES
            own.in_article |= role in ("main", "article")
            own.header |= role == "banner" and not above.in_article
            if tag not in ("html", "body"):
                names = f"{told.get('class', '')} {told.get('id', '')}"
                negative = bool(NEGATIVE.search(names))
                own.name |= negative
                own.doubtful |= bool(DOUBTFUL.search(names))
                own.header |= not own.in_article and bool(HEADER.search(names))
                own.content |= not negative and bool(POSITIVE.search(names))
        self.places[tag].append(len(self.stack))
        self.stack.append(own)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.boundary()
        at = self.last((tag,))
        if at > self.last(() if tag in BLOCK and tag != "p" else ENDS_END_P if tag == "p" else BLOCK):
            self.cut(at)


def read_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Text that no tag ends, or a tag that isn't ended, is no error."""
    reader, at, n = Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            reader.text(page[at:])
            break
        if lt > at:
            reader.text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after and after in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/" or (after.isascii() and after.isalpha()):
            m = TAG.match(page, lt)
            if m is None:
                end = page.find(">", lt)
                if after == "/" and not page[lt + 2 : lt + 3].isalpha():
                    at = n if end < 0 else end + 1
                    continue
                if end < 0:
                    break  # the page ends in a tag
                m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[lt : end + 1])
                at, attributes = end + 1, ""
            else:
                at, attributes = m.end(), m[3]
            tag = m[2].lower()
            if m[1]:
                reader.end(tag)
            elif tag in RAW or tag == "xmp":
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if tag == "textarea" or tag == "iframe":
                    reader.boundary()
                if tag == "xmp":  # a block of text as it stands
                    reader.start(tag, attributes, False)
                    reader.text(html.escape(page[at : n if close is None else close.start()]))
                    reader.end(tag)
                at = n if close is None else close.end()
            else:
                reader.start(tag, attributes, attributes.endswith("/"))
        else:
            reader.text("<")
            at = lt + 1
    reader.boundary()
    return reader.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    out = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(out, blocks, strict=True):
        n, at = len(b.text), b.at
        links = min(1.0, b.link_chars / n)
        row[:] = (1, at.element, at.name, at.header, at.doubtful, at.in_article, at.content, links, links * at.listed, min(3.0, n / 80), b.text.endswith(ENDINGS), at.heading, n < 300 and bool(NOTICE_TEXT.search(b.text)))
    return out


def _parent(block: Open) -> Open:
    return block.above.block if block.above is not None else block


def _apart(a: Open, b: Open) -> int:
    """Block elements on the way from one to the other in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = _parent(a)
        else:
            b = _parent(b)
        steps += 1
    return steps


#: What is left of an edge between a block that is marked as boilerplate by an element or a name and one that is marked as content.
CROSSING = 0.1


def edges_of(blocks: list[Block], near: float, akin: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, the weaker the further apart in the tree, and between a parent's successive blocks."""
    marks = [-1 if b.at.element or b.at.name or b.at.header else 1 if b.at.in_article or b.at.content else 0 for b in blocks]
    across = lambda i, j: CROSSING if marks[i] * marks[j] < 0 else 1.0
    out = []
    last_in: dict[int, int] = {}
    own = [b.at.block for b in blocks]
    for j, at in enumerate(own):
        if j:
            out.append((j - 1, j, near * across(j - 1, j) / (1 + 0.5 * max(0, _apart(own[j - 1], at) - 2))))
        parent = id(_parent(at))
        i = last_in.get(parent)
        if i is not None and i < j - 1:
            out.append((i, j, akin * across(i, j)))
        last_in[parent] = j
    return [e for e in out if e[2] > 0]


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side (content) of the minimum cut.

    lean: the terminal capacity, to the sink where above 0, from the source where below.
    A node whose terminal capacity is more than all its edges' together keeps its side in
    every minimum cut, so that such nodes are settled first; for the rest the flow is
    augmented along shortest paths in levels.
    """
    n = len(lean)
    lean = list(lean)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    weight = [0.0] * n
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
        weight[i] += c
        weight[j] += c
    side: list[bool | None] = [None] * n
    queue = [i for i in range(n) if abs(lean[i]) > weight[i]]
    for i in queue:
        side[i] = lean[i] < 0
    while queue:
        i = queue.pop()
        for j, c in near[i]:
            if side[j] is None:
                weight[j] -= c
                lean[j] += -c if side[i] else c
                if abs(lean[j]) > weight[j] + 1e-12:
                    side[j] = lean[j] < 0
                    queue.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        number = {i: k for k, i in enumerate(left)}
        inner = [(number[i], number[j], c) for i, j, c in edges if side[i] is None and side[j] is None]
        for i, content in zip(left, _max_flow_side([lean[i] for i in left], inner), strict=True):
            side[i] = content
    return [bool(s) for s in side]


def _max_flow_side(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes that the source still reaches after a maximum flow (Dinic's algorithm)."""
    n = len(lean)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(lean):
        if z < 0:
            add(s, i, -z, 0.0)
        elif z > 0:
            add(i, t, z, 0.0)
    for i, j, c in edges:
        add(i, j, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        order = [s]
        for a in order:
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    order.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                back = path.pop()
                a = to[back ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


@dataclass(frozen=True)
class Weights:
    """The classifier's weights of FEATURES, and the capacities of the smoothness edges."""

    costs: tuple[float, ...]
    near: float
    akin: float


#: Log-odds that no block goes beyond, so that no classifier's certainty makes neighbours count for nothing.
MOST_ODDS = 6.0


def label(blocks: list[Block], weights: Weights) -> tuple[list[bool], list[bool]]:
    """Whether each block is content: by the minimum cut, and by its own log-odds alone."""
    lean = np.clip(features(blocks) @ np.array(weights.costs), -MOST_ODDS, MOST_ODDS)
    return minimum_cut(lean.tolist(), edges_of(blocks, weights.near, weights.akin)), (lean < 0).tolist()


def main_text(page: str, weights: Weights | None = None) -> str:
    """The page's content blocks in page order; empty if there are none."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    return SEPARATOR.join(b.text for b, c in zip(blocks, label(blocks, weights or fitted())[0], strict=True) if c)


def fitted() -> Weights:
    """The weights fitted to made pages, once a process."""
    from folioforge.llm import html_training

    return html_training.fitted()


def _texts(weights: Weights):
    def run(batches):
        for batch in batches:
            got = [main_text(x or "", weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(got, pa.string())], names=["id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """Rows (id, url, text), one for each row of pages.

    Null html counts as empty; a page without content has an empty text; rows that repeat
    stay; null ids and urls stay null; other columns are not looked at; no rows give no
    rows. Pages are read whole, at any depth of elements. The weights are fitted at the driver
    in a few seconds where none are given.
    """
    prepare(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_texts(weights or fitted()), "id long, url string, text string")


def changed(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """One row: how many blocks the pages have, and of how many the cut changes the label that their own log-odds give."""
    weights = weights or fitted()

    def run(batches):
        for batch in batches:
            n = m = 0
            for x in batch.column("html").to_pylist():
                own = read_blocks(x or "")
                cut, alone = label(own, weights) if own else ([], [])
                n, m = n + len(own), m + sum(a != b for a, b in zip(cut, alone, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m])], names=["blocks", "changed"])

    told = prepare(pages.sparkSession) and pages.select(F.col(html_col).alias("html")).mapInArrow(run, "blocks long, changed long")
    return told.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
