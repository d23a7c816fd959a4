"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. Two kinds of nodes are labelled "content" or "boilerplate":

* blocks. A logistic classifier of what a block looks like (length, share of link text, sentence end, kind of
  element, whether the page's article is elsewhere) gives its terminal capacity, at most ``MOST`` either way;
* elements that say what they hold, by tag or by class, id or role (``article``, ``nav``, ``class="comments"``).
  Their capacity is ``EVIDENCE`` for each block inside.

Smoothness edges tie neighbours in page order, siblings, each block to the nearest element that says something
(``HELD``); an arc from each such element to the next one around it (``NESTED`` for each block inside) costs where the inner one
is content and the outer one is not. The minimum cut is the labelling of least
total cost. So short titles and linked lists follow their article, sentences in an advert follow the advert, an
element named after content that holds links only is outvoted by its blocks, and where no element says
anything, neighbours decide together. Nodes whose own capacity outweighs all their edges are settled first and nodes with
one edge left are folded into its other end (any minimum cut agrees); a maximum flow over what is left decides the rest.

The classifier's weights for length, links and sentence ends (not those for tags, which would repeat what labels the sample) are fitted on at most ``sample_pages`` pages, those of the smallest hashes of their ids, whose blocks inside
``article`` or ``main`` and inside ``nav``, ``footer`` and the like are labelled by these; a Gaussian prior holds the weights
to ``WEIGHTS``, so a few pages change little and pages without such elements nothing.

Text is whole: character references are decoded, white space in a block becomes one space, blocks are trimmed
and joined in page order by a line break; nothing is capped. Defined results: null or blank html, and pages
without content, give an empty text; markup cut off at the end of a page is dropped; tags left open or closed
twice do not lose text, but for script, style, title and textarea, which run to their end tag; a quote that is not closed
before the next tag ends with its own tag; inline elements nested over 512 deep are not told apart; pages are scanned once, in time that grows with
their length; equal rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_VALUE_NEXT = re.compile(r"[\"'>]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|none", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: Elements that run to their end tag, whatever they hold.
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea")}
#: Elements whose text is no text of the page, where they are closed; the second ones leave a space.
_SKIPPED, _SPACED = frozenset("noscript template select svg iframe object math button".split()), frozenset("textarea select iframe object button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - {"html", "body", "head"}
_P_STOPS = frozenset("article section div td th li aside nav header footer form blockquote".split())
_SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that hold one block each: blocks in them are siblings if these are.
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt td th pre blockquote".split())
_BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset head".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|repl(?:y|ies)|share|sharing|social|related|recommend\w*|promo\w*|sponsor\w*|newsletter|subscribe|signup|login|pop-?up|modal|overlay|widgets?|pag(?:er|ination)|copyright|toolbar|search|contentinfo|complementary|navigation)(?:$|[\s_-])",
    re.I,
)
#: What a layout has, not what it is.
_LAYOUT = re.compile(r"\b(?:has|have|with|without|no|is)[_-]\S+", re.I)
#: An article of this one name is not the page's own.
_BAD_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|reply|related|widget|promo|sponsored|ads?|advert)(?:\s|$)", re.I)
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
#: Smoothness: consecutive blocks (same parent, other parent), siblings, a block and its element, an element and the one around it.
ADJACENT, APART, SIBLING, HELD, NESTED = 0.5, 0.15, 0.4, 5.0, 8.0
#: What an element says for each block inside: a bad tag or name, an article or main, a name of content. ``NESTED`` outweighs what good
#: elements and blocks inside a bad one say (1.5 + 3 + ``MOST``), and so does a bad one.
EVIDENCE = {"bad": -8.0, "article": 3.0, "name": 1.5}
#: The classifier's log-odds of "content" before any page is seen, those that are fitted (what the text and its links look like), and their bound.
WEIGHTS = {"base": -1.2, "length": 0.6, "links": -3.5, "sentence": 0.8, "paragraph": 1.2, "heading": 1.2, "item": 0.0, "elsewhere": -1.0}
FITTED = ("base", "length", "links", "sentence")
MOST = 2.5
_DEEPEST = 512


class Element:
    """An open element: its tag, what it says (a key of ``EVIDENCE`` or ``""``), the nearest element around it or itself that says something, and a number."""

    __slots__ = ("around", "link", "number", "says", "tag")

    def __init__(self, tag: str, number: int, says: str, around: Element | None, link: bool) -> None:
        self.tag, self.number, self.says, self.around, self.link = tag, number, says, around, link

    def governor(self) -> Element | None:
        return self if self.says else self.around


@dataclass
class Block:
    text: str
    in_links: int
    parent: Element
    owner: Element


@dataclass
class Graph:
    """The nodes' gains (blocks first), edges and arcs, and the classifier's log-odds of the blocks."""

    gain: list[float] = field(default_factory=list)
    edges: list[tuple[int, int, float]] = field(default_factory=list)
    arcs: list[tuple[int, int, float]] = field(default_factory=list)
    own: list[float] = field(default_factory=list)


def _hidden(attributes: str) -> bool:
    """Whether an attribute of the element hides it; names count outside quotes only."""
    if not _MAY_HIDE.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and _NOT_SHOWN.search(value)) or (name == "aria-hidden" and value.strip().lower().startswith("true")):
            return True
    return False


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` ends (its ``>``); -1 if it is cut off.

    A quote belongs to the tag up to the same quote, unless a tag ends and another begins before that.
    """
    while m := _VALUE_NEXT.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        end = page.find(">", m.end(), close if close >= 0 else len(page))
        if close < 0:
            return end
        if end >= 0 and page.find("<", m.end(), end) < 0 and page.find("<", end, close) >= 0:
            return end
        at = close + 1
    return -1


#: ("text", text, "") or ("open" or "close" or "raw", tag, attributes)
Token = tuple[str, str, str]


def tokens(page: str) -> list[Token]:
    """Texts and tags of a page in order; comments and declarations are gone. Each place is looked at a bounded number of times."""
    out: list[Token] = []
    at, last, n = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        follows = page[at + 1 : at + 2]
        kind, tag, attributes = "", "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
        elif m := _NAME.match(page, at + (2 if follows == "/" else 1)):
            kind, tag, close = "close" if follows == "/" else "open", m[0].lower(), _tag_end(page, m.end())
            end = n if close < 0 else close + 1
            if close < 0:
                kind = ""
            elif kind == "open":
                attributes = page[m.end() : close]
                if tag in _RAW:
                    done = _RAW[tag].search(page, end)
                    kind, end = "raw", done.end() if done else n
        else:
            at += 1
            continue
        if at > last:
            out.append(("text", page[last:at], ""))
        if kind:
            out.append((kind, tag, attributes))
        at = last = end
    if last < n:
        out.append(("text", page[last:], ""))
    return out


def _empty(tag: str, attributes: str, foreign: bool) -> bool:
    """Whether a start tag has no content: void elements, and self-closed ones of SVG and MathML."""
    return tag in _VOID or (attributes.endswith("/") and (foreign or tag in ("svg", "math")))


def _skips(found: list[Token]) -> dict[int, int]:
    """The end tag of each skipped element that has one of its own; what is left open to the end of its parent has none."""
    stack, open_, ends = [], Counter(), {}
    for i, (kind, tag, attributes) in enumerate(found):
        if kind == "open":
            if not _empty(tag, attributes, bool(open_["svg"] or open_["math"])):
                stack.append((tag, i))
                open_[tag] += 1
        elif kind == "close" and open_[tag]:
            while True:
                top = stack.pop()
                open_[top[0]] -= 1
                if top[0] == tag:
                    break
            if tag in _SKIPPED:
                ends[top[1]] = i
    return ends


class _Stack:
    """The open elements, and how many there are of each tag."""

    def __init__(self) -> None:
        self.open = [Element("", 0, "", None, False)]
        self.count: Counter[str] = Counter()

    def push(self, x: Element) -> None:
        self.open.append(x)
        self.count[x.tag] += 1

    def close_from(self, i: int) -> None:
        for x in self.open[i:]:
            self.count[x.tag] -= 1
        del self.open[i:]

    def close(self, tags: frozenset[str] | set[str], stops: frozenset[str] | set[str] = frozenset()) -> None:
        """Close the last open element of these tags that no stop stands before."""
        if any(self.count[t] for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    self.close_from(i)
                    return
                if self.open[i].tag in stops:
                    return


def _news(says: str, around: Element | None) -> str:
    """What an element says beyond the one around it."""
    known = "" if around is None else around.says
    return "" if says == known or (says == "name" and known == "article") else says


def _says(tag: str, attributes: str) -> str:
    """What a block-level element says about its text."""
    good = "article" if tag in ("article", "main") else ""
    if tag in _BAD_TAGS:
        return "bad"
    if attributes and tag not in ("html", "body"):
        if _hidden(attributes):
            return "bad"
        names = _LAYOUT.sub(" ", " ".join(x for found in _NAMES.findall(attributes) for x in found if x))
        if names:
            if tag != "main" and (_BAD_ARTICLE if tag == "article" else _BAD_NAME).search(names):
                return "bad"
            return good or ("name" if _GOOD_NAME.search(names) else "")
    return good


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    stack, out, parts, in_links, numbers = _Stack(), [], [], 0, 1
    found = tokens(page)
    ends = _skips(found) if any(k == "open" and t in _SKIPPED for k, t, _ in found) else {}

    def flush() -> None:
        nonlocal in_links
        if parts and (text := " ".join("".join(parts).split())):
            at = next(i for i in range(len(stack.open) - 1, -1, -1) if stack.open[i].tag in _BLOCKS or not i)
            owner = stack.open[at]
            out.append(Block(text, in_links, stack.open[at - 1] if owner.tag in _LEAVES else owner, owner))
        parts.clear()
        in_links = 0

    until = -1
    for i, (kind, tag, attributes) in enumerate(found):
        if i <= until:
            continue
        if kind == "text":
            raw = unescape(tag) if "&" in tag else tag
            parts.append(raw)
            if stack.open[-1].link:
                in_links += len(raw)
            continue
        if kind == "raw" or i in ends:
            if tag in _SPACED:
                parts.append(" ")
            until = ends.get(i, i)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        if kind == "close":
            stack.close({tag})
            continue
        if _empty(tag, attributes, bool(stack.count["svg"] or stack.count["math"])):
            continue
        if tag in _CLOSES_P:
            stack.close({"p"}, _P_STOPS)
        if tag in _SELF_CLOSING:
            stack.close(*_SELF_CLOSING[tag])
        top = stack.open[-1]
        if block or len(stack.open) <= _DEEPEST:
            stack.push(Element(tag, numbers, _news(_says(tag, attributes), top.governor()) if block else "", top.governor(), top.link or tag == "a"))
            numbers += 1
    flush()
    return out


def features(b: Block, elsewhere: bool) -> list[float]:
    """What a block looks like, in the order of ``WEIGHTS``."""
    tag = b.owner.tag
    return [
        1.0,
        min(math.log1p(len(b.text)) - 3, 3.0),
        min(b.in_links / len(b.text), 1.0),
        float(b.text[-1] in ".!?…。"),
        float(tag in ("p", "pre", "blockquote")),
        float(tag[:1] == "h" and tag[1:].isdigit()),
        float(tag in ("li", "dt", "dd", "td", "th")),
        float(elsewhere),
    ]


def _inside(e: Element | None, says: str) -> bool:
    while e is not None and e.says != says:
        e = e.around
    return e is not None


def graph(found: list[Block], weights: list[float]) -> Graph:
    """The page's nodes and edges."""
    out = Graph()
    has_article = any(_inside(b.owner.governor(), "article") for b in found)
    nodes: dict[int, int] = {}
    siblings: dict[int, int] = {}
    elements: dict[int, Element] = {}
    size: Counter[int] = Counter()
    for b in found:
        e = b.owner.governor()
        z = sum(w * x for w, x in zip(weights, features(b, has_article and e is None), strict=True))
        out.own.append(z)
        out.gain.append(min(max(z, -MOST), MOST))
        while e is not None:
            elements[e.number] = e
            size[e.number] += 1
            e = e.around
    for number, e in elements.items():
        nodes[number] = len(out.gain)
        out.gain.append(EVIDENCE[e.says] * size[number])
    for number, e in elements.items():
        if e.around is not None:
            out.arcs.append((nodes[number], nodes[e.around.number], NESTED * size[number]))
    for i, b in enumerate(found):
        if i:
            out.edges.append((i - 1, i, ADJACENT if found[i - 1].parent is b.parent else APART))
        if b.parent.number in siblings:
            out.edges.append((siblings[b.parent.number], i, SIBLING))
        siblings[b.parent.number] = i
        if (e := b.owner.governor()) is not None:
            out.edges.append((i, nodes[e.number], HELD))
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]], arcs: list[tuple[int, int, float]] = ()) -> list[bool]:
    """The labelling of least cost.

    ``gain[i]`` is lost where i is not content (if negative, where it is), an edge's weight where its ends differ,
    an arc's where it leads from content to boilerplate.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]  # near[a][b]: lost where a is content and b is not
    for a, b, w in arcs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b].setdefault(a, 0.0)
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain, label = list(gain), [None] * n
    away = [sum(x.values()) for x in near]
    toward = [sum(near[j][i] for j in x) for i, x in enumerate(near)]
    folded: list[tuple[int, int]] = []
    gone = [False] * n
    open_ = deque(range(n))
    while open_:
        i = open_.popleft()
        if gone[i]:
            continue
        if gain[i] > away[i] + 1e-9 or -gain[i] > toward[i] + 1e-9:
            label[i], gone[i] = gain[i] > 0, True
            for j, w in near[i].items():
                back = near[j].pop(i)
                away[j] -= back
                toward[j] -= w
                gain[j] += w if label[i] else -back
                open_.append(j)
        elif len(near[i]) == 1:
            ((j, w),) = near[i].items()
            gone[i] = True
            away[j] -= near[j].pop(i)
            toward[j] -= w
            gain[j] += gain[i]
            folded.append((i, j))
            open_.append(j)
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        for i, content in zip(rest, _flow(rest, gain, near), strict=True):
            label[i] = content
    for i, j in reversed(folded):
        label[i] = label[j]
    return label


def _flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow in phases of shortest paths (Dinic) from content to boilerplate; true for what the source still reaches."""
    number = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    to: list[list[int]] = [[] for _ in range(n)]
    room: list[list[float]] = [[] for _ in range(n)]
    back: list[list[int]] = [[] for _ in range(n)]
    for a in rest:
        for b, w in near[a].items():
            if a < b:
                x, y = number[a], number[b]
                back[x].append(len(to[y]))
                back[y].append(len(to[x]))
                to[x].append(y)
                to[y].append(x)
                room[x].append(w)
                room[y].append(near[b][a])
    source, sink = [max(gain[i], 0.0) for i in rest], [max(-gain[i], 0.0) for i in rest]
    while True:
        level = [-1] * n
        queue = deque(x for x in range(n) if source[x] > 1e-12)
        for x in queue:
            level[x] = 0
        last = None
        while queue:
            x = queue.popleft()
            if last is not None and level[x] > last:
                break
            if sink[x] > 1e-12:
                last = level[x]
            for y, r in zip(to[x], room[x], strict=True):
                if r > 1e-12 and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        if last is None:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while level[start] == 0 and source[start] > 1e-12:
                path, x = [], start
                while sink[x] <= 1e-12 or level[x] > last:
                    while at[x] < len(to[x]) and not (room[x][at[x]] > 1e-12 and level[to[x][at[x]]] == level[x] + 1 <= last):
                        at[x] += 1
                    if at[x] < len(to[x]):
                        path.append((x, at[x]))
                        x = to[x][at[x]]
                    elif path:
                        x, k = path.pop()
                        at[x] = k + 1
                    else:
                        x = -1
                        break
                if x < 0:
                    break
                amount = min([source[start], sink[x], *(room[a][k] for a, k in path)])
                source[start] -= amount
                sink[x] -= amount
                for a, k in path:
                    room[a][k] -= amount
                    room[to[a][k]][back[a][k]] += amount


def labelled(page: str | None, weights: list[float] | None = None) -> tuple[list[Block], list[bool], list[float]]:
    """The blocks, whether the cut calls them content, and the classifier's log-odds."""
    found = blocks(page or "")
    g = graph(found, list(WEIGHTS.values()) if weights is None else weights)
    return found, minimum_cut(g.gain, g.edges, g.arcs)[: len(found)], g.own


def extract(page: str | None, weights: list[float] | None = None) -> str:
    """The main text of one page."""
    found, labels, _ = labelled(page, weights)
    return "\n".join(b.text for b, content in zip(found, labels, strict=True) if content)


def fit(pages: DataFrame, sample_pages: int = 2_000, prior: float = 30.0, rounds: int = 30) -> list[float]:
    """The classifier's weights from the blocks of a bounded sample of pages, held to ``WEIGHTS`` by a Gaussian prior."""
    prepare(pages.sparkSession)
    names = [f"x{k}" for k in range(len(WEIGHTS))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for page in b.column(0).to_pylist():
                sums: dict[tuple, list[float]] = {}
                for x in blocks(page or ""):
                    e = x.owner.governor()
                    good = _inside(e, "article") and not _inside(e, "bad")
                    if good or _inside(e, "bad"):
                        v = features(x, False)
                        key = (good, *(round(4 * y) / 4 for y in v))
                        sums[key] = sums.get(key, 0.0) + 1.0
                out += [(float(k[0]), n, *k[1:]) for k, n in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*out, strict=True) if out else [[]] * (len(names) + 2))], ["y", "n", *names])

    sample = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    chosen = pages.join(F.broadcast(sample), "page_id", "left_semi").select(F.col("html").cast("string").alias("html"))
    data = chosen.mapInArrow(rows, ", ".join(f"{c} double" for c in ["y", "n", *names])).groupBy("y", *names).agg(F.sum("n").alias("n")).orderBy("y", *names).toPandas()
    every = np.array(list(WEIGHTS.values()))
    own = np.array([k in FITTED for k in WEIGHTS])
    x, y, n = data[names].to_numpy(float), data["y"].to_numpy(float), data["n"].to_numpy(float)
    fixed, x, start = x[:, ~own] @ every[~own], x[:, own], every[own]
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w)), x.T @ (n * (p - y)) + prior * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    every[own] = np.round(w, 6)
    return every.tolist()


def extract_pages(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_content, n_turned`` of every row; ``n_turned`` blocks have another label than the classifier alone would give them."""
    prepare(pages.sparkSession)
    weights = fit(pages) if weights is None else weights
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, counts = [], []
            for page in b.column(2).to_pylist():
                found, labels, own = labelled(page, weights)
                texts.append("\n".join(x.text for x, content in zip(found, labels, strict=True) if content))
                counts.append((len(texts[-1]), len(found), sum(labels), sum(c != (z > 0) for c, z in zip(labels, own, strict=True))))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "n_blocks", "n_content", "n_turned"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(of, f"{kinds}, text string, n_chars long, n_blocks long, n_content long, n_turned long")
