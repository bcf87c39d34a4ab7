"""HTML extraction by minimum-cut labelling: the article's blocks against the rest.

A page is read into blocks of text. A logistic classifier gives each its log odds of
being content; they become its capacity from the source or to the sink. It sees what a
block looks like and how many elements around it are named as content or as other. It is
fitted on blocks whose markup names what they are (at most ``TRAINING_PAGES`` pages), each
once with its markup and once without, so it learns what the looks say alone. Blocks next
to each other, and neighbours under one parent, are tied by edges that are stronger the
nearer they stand in the document tree. The minimum cut separates content from boilerplate,
so a short line inside the article stays with it, and one odd paragraph in a menu does not.

Scripts, styles, forms, frames, templates and the head are never blocks; what a page marks as hidden,
or shows without scripts only, is text like any other. Character
references are decoded, white space inside a block becomes one space, a line break
too; blocks are joined in page order by two line breaks.

Defined cases: where the pages do not have blocks of both kinds to learn from, fixed
weights take the place of fitted ones, so prose without markup stays; null or empty html, or a page without content blocks, gives an empty
text; an unfinished tag at the end is no text; unclosed and crossing elements are
closed as their parents are; rows that repeat give the same text; an empty table gives
an empty result; all columns pass through but ``text``, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import free_name, workers_can_import

TRAINING_PAGES = 1000
#: Strength of the ties between neighbours in text, and under one parent.
NEXT, SIBLING = 1.0, 1.0
#: Log odds per element of the markup around a block: they label the blocks to learn from,
#: and stand for learnt ones where weights are those of the looks alone.
FOR, AGAINST = 3.0, -5.0
#: Elements around a block that count, of either kind.
COUNTED = 2
#: Weights of the looks (see ``_looks``) where the pages do not have both kinds of blocks.
UNFITTED = (-1.0, 1.0, -4.0, 1.0, 0.5, 1.5, -1.5, -3.0, 0.5)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset(
    """button datalist form head iframe optgroup option script select style template textarea
    title""".split()
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main
    menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset("aside dialog footer menu nav".split())
CONTENT_ROLES = frozenset(("article", "main"))
OTHER_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form navigation search".split()
)
CONTENT_NAMES = frozenset("article content entry main post prose story".split())
OTHER_NAMES = frozenset(
    """ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disqus footer gdpr header legal login masthead menu modal
    nav navbar navigation newsletter notice pager pagination popup promo related replies
    search share sharing sidebar signup social sponsor sponsored subscribe toolbar
    widget""".split()
)
#: Which open elements a start tag closes, up to the element that bounds the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_NAME = re.compile(r"[A-Za-z]+")
_HEAD = frozenset("base link meta noscript script style template title".split())


class _Element:
    __slots__ = ("tag", "depth", "parent", "named", "other", "dropped", "content")

    def __init__(self, tag, parent, attrs=()):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.dropped = bool(parent and parent.dropped) or tag in DROPPED
        self.content = bool(parent and parent.content) or tag in CONTENT_TAGS
        sign = (tag in CONTENT_TAGS) - (tag in OTHER_TAGS)
        if tag == "header" and not (parent and parent.content):
            sign = -1
        names = set()
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role":
                sign = sign or (value in CONTENT_ROLES) - (value in OTHER_ROLES)
            elif name in ("class", "id") and tag not in ("html", "body"):
                names.update(_NAME.findall(value))
        if sign >= 0:
            # Names of both kinds, as in "content has-sidebar", say nothing.
            said = bool(names & CONTENT_NAMES) - bool(names & OTHER_NAMES)
            sign = said or sign
        self.named = (parent.named if parent else 0) + (sign > 0)
        self.other = (parent.other if parent else 0) + (sign < 0)

    def odds(self) -> float:
        return FOR * self.named + AGAINST * self.other


class _Blocks(HTMLParser):
    """Collects [text, characters in links, element it stands in]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = _Element("", None)
        self.blocks: list[tuple[str, int, _Element]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        # Open elements by tag, and the open blocks, each the innermost last.
        self.open: dict[str, list[_Element]] = {}
        self.open_blocks: list[_Element] = []

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, self.top))
        self.parts, self.linked = [], 0

    def leave(self, element):
        """Closes everything that is open up to and with ``element``."""
        while True:
            closed, self.top = self.top, self.top.parent
            self.open[closed.tag].pop()
            if closed.tag in BLOCK:
                self.open_blocks.pop()
            elif closed.tag == "a":
                self.links -= 1
            if closed is element:
                return

    def innermost(self, tags):
        if tags is BLOCK:
            return self.open_blocks[-1] if self.open_blocks else None
        found = [self.open[tag][-1] for tag in tags if self.open.get(tag)]
        return max(found, key=lambda element: element.depth, default=None)

    def find(self, tags, bounds):
        """The innermost open element of these tags that stands inside no bound further in."""
        element, bound = self.innermost(tags), self.innermost(bounds)
        if element is None or bound is not None and bound.depth > element.depth:
            return None
        return element

    def handle_starttag(self, tag, attrs):
        if self.top.tag == "head" and tag not in _HEAD:
            self.leave(self.top)
        if tag in VOID:
            if tag in BLOCK:
                self.end_block()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.end_block()
            closes, bounds = CLOSES.get(tag, (("p",), ()))
            open_ = self.find(closes, bounds)
            if open_ is not None:
                self.leave(open_)
        elif tag == "a" and self.links:
            # A link cannot hold another one.
            open_ = self.find(("a",), BLOCK)
            if open_ is not None:
                self.leave(open_)
        self.links += tag == "a"
        self.top = _Element(tag, self.top, attrs)
        self.open.setdefault(tag, []).append(self.top)
        if tag in BLOCK:
            self.open_blocks.append(self.top)

    def handle_startendtag(self, tag, attrs):
        # Only void elements end themselves in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in DROPPED:
            self.end_block()
        # An inline end tag does not close the block it stands in.
        open_ = self.find((tag,), () if tag in BLOCK or tag in DROPPED else BLOCK)
        if open_ is not None:
            self.leave(open_)

    def handle_data(self, data):
        if not self.top.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[tuple[str, int, _Element]]:
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"[A-Za-z/!?]", html[cut + 1 : cut + 2]):
        html = html[:cut]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.blocks


def _looks(text: str, linked: int, element: _Element) -> list[float]:
    """What a block looks like: its text, not what the markup around it is called."""
    words = text.count(" ") + 1
    stops = sum(map(text.count, ".!?"))
    return [
        1.0,
        math.log1p(words),
        min(1.0, linked / len(text)),
        min(1.0, stops / words * 5),
        min(1.0, text.count(",") / words * 5),
        float(element.tag in HEADINGS),
        float(element.tag in ("li", "td", "th")),
        float("\N{COPYRIGHT SIGN}" in text or "|" in text),
        float(text[-1] in ".!?:;\"'\N{RIGHT DOUBLE QUOTATION MARK}"),
    ]


def _markup(element: _Element) -> list[float]:
    """How many elements around a block are named as content, and as other."""
    return [float(min(COUNTED, element.named)), float(min(COUNTED, element.other))]


def _fit(rows: list[tuple[list[float], int]]) -> np.ndarray:
    """Logistic weights by Newton steps with a ridge; fixed ones without both kinds of blocks."""
    if len({label for _, label in rows}) < 2:
        return np.array([*UNFITTED, FOR, AGAINST])
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    # Both kinds weigh the same in all.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    size = x.shape[1]
    w = np.zeros(size)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(size)
        w = w + np.linalg.solve(curve, slope)
    return w


def train(pages: DataFrame, html: str = "html", rows: int = TRAINING_PAGES) -> np.ndarray:
    """Weights fitted on the blocks of at most ``rows`` pages, the first by a hash of the page.

    A block inside an article or main element counts as content, one inside a menu,
    footer, aside or the like as other; blocks of which the markup says nothing are not used.
    """
    workers_can_import(pages.sparkSession)
    chosen = pages.select(F.xxhash64(pages[html]).alias("_order"), pages[html].alias("html"))
    chosen = chosen.filter(F.col("html").isNotNull())
    # Only hashes are sorted. Pages that repeat are joined before they are moved.
    first = chosen.select("_order").distinct().orderBy("_order").limit(rows)
    last = first.agg(F.max("_order")).first()[0]
    chosen = chosen.filter(F.col("_order") <= F.lit(0 if last is None else last))
    chosen = chosen.groupBy("_order").agg(F.min("html").alias("html"))

    def learn(batches):
        known = []
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for block in blocks(page):
                    if odds := block[2].odds():
                        looks = _looks(*block)
                        known.append((looks + _markup(block[2]), int(odds > 0)))
                        known.append((looks + [0.0, 0.0], int(odds > 0)))
        weights = _fit(known)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tolist()]})

    fitted = chosen.repartition(1).sortWithinPartitions("_order").mapInArrow(learn, "weights array<double>")
    one = fitted.first()
    return _fit([]) if one is None else np.array(one["weights"])


def min_cut(costs: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    A positive cost is the capacity from the source, a negative one that to the sink; a
    tie (i, j, c) has capacity c both ways. Maximum flow by levels, as Dinic's.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a, b, forth, back):
        edges[a].append(len(to))
        to.append(b)
        room.append(forth)
        edges[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, cost in enumerate(costs):
        if cost > 0:
            tie(source, i, cost, 0)
        elif cost < 0:
            tie(i, sink, -cost, 0)
    for i, j, c in ties:
        tie(i, j, c, c)

    def levels():
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[sink] >= 0:
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # Back to before the first edge that is full.
                full = next(k for k, e in enumerate(path) if not room[e])
                node = to[path[full] ^ 1]
                del path[full:]
                continue
            while at[node] < len(edges[node]):
                e = edges[node][at[node]]
                if room[e] > 0 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(edges[node]):
                path.append(edges[node][at[node]])
                node = to[path[-1]]
            elif path:
                node = to[path.pop() ^ 1]
                at[node] += 1
            else:
                break
    return [x >= 0 for x in level[:n]]


def _steps(a: _Element, b: _Element) -> int:
    """Edges between two elements in the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(html: str | None, weights: list[float]) -> str:
    found = blocks(html or "")
    costs, ties, last = [], [], {}
    if len(weights) == len(UNFITTED):
        weights = [*weights, FOR, AGAINST]
    for i, (text, linked, element) in enumerate(found):
        seen = _looks(text, linked, element) + _markup(element)
        costs.append(round(1000 * sum(w * x for w, x in zip(weights, seen, strict=True))))
        if i:
            steps = _steps(found[i - 1][2], element)
            ties.append((i - 1, i, round(1000 * NEXT / (1 + steps))))
        parent = id(element.parent)
        if last.get(parent, i - 1) < i - 1:
            steps = _steps(found[last[parent]][2], element)
            ties.append((last[parent], i, round(1000 * SIBLING / (1 + steps))))
        last[parent] = i
    stays = min_cut(costs, ties)
    return "\n\n".join(b[0] for b, yes in zip(found, stays, strict=True) if yes)


def extracted(pages: DataFrame, weights: np.ndarray, html: str = "html") -> DataFrame:
    """All columns of the pages and ``text``, which replaces one of that name."""
    workers_can_import(pages.sparkSession)
    model = [float(w) for w in weights]
    rest, own = pages.drop("text"), free_name(pages, "_html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def extract(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                texts = [main_text(page, model) for page in piece.column(own).to_pylist()]
                columns = [piece.column(c) for c in range(piece.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.string())], names=[*piece.schema.names[:-1], "text"]
                )

    return rest.withColumn(own, pages[html].cast("string")).mapInArrow(
        extract, f"{schema}, text string"
    )
