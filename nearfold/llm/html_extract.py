"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks (runs of text between block-level tags).  A linear
classifier over the block's enclosing tags, class names, link share and
length gives the cost of calling it content and the cost of calling it
boilerplate; these are the capacities from the source and to the sink.
Neighbouring blocks, and blocks of one parent element, are joined by
smoothness edges, so a lone odd block follows its surroundings.  The minimum
cut (max-flow) separates content from boilerplate.

Names like ``has-sidebar`` on a wrapper say what lies within, not what the
wrapper is.  So names on html and body do not count, and boilerplate words do
not count on main (or role main), on what holds main, and on what holds the
longest article or a h1 together with most of the text that would otherwise be
content.  Words that may also name an article's subject (``legal-news``,
``share-price``) do not count on what holds most of such text either, where the
page has no article, main or h1.

Pages are independent: the work is map-only, one page at a time.

Defined results: null or empty html, and a page whose blocks are all
boilerplate, give an empty text; unclosed, stray or cut-off tags end where
HTML's own rules end them, at the latest with the page; repeated rows give
repeated results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready

#: A tag, a comment, a declaration.  A quote opens a quoted value only right behind "="; what is not closed ends with
#: the page.  All repeats are possessive and none can fail late, so a page is read once.
_MARK = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)(>|\Z)",
    re.S,
)
#: An attribute: its name and its value in double, single or no quotes.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++))?)?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
#: Words of a class name or id: they end at other characters and at a change of case.
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: White space of HTML and the no-break space's kin.
_SPACE = re.compile(r"\s+")

#: Elements whose text is never shown.
_SILENT = frozenset("script style noscript template textarea title svg math iframe object select option datalist canvas audio video head".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening tag closes by itself.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Elements beyond which an implied or unmatched end does not reach.
_FENCE = frozenset("article section main div nav aside header footer form ul ol table body html".split())

#: The classifier: log odds for content.  Fixed values.
BIAS = 0.3
TAG_ODDS = {"article": 3.0, "main": 2.0, "p": 0.8, "h1": 0.8, "h2": 0.6, "h3": 0.6, "h4": 0.4, "blockquote": 0.5, "pre": 0.5, "td": -0.2, "li": -0.3,
            "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -3.0, "button": -9.0, "menu": -9.0, "dialog": -9.0, "fieldset": -9.0}
WORD_ODDS = {"content": 1.5, "article": 1.5, "post": 0.8, "entry": 1.2, "story": 1.2, "body": 0.3, "main": 1.0,
             "ad": -9.0, "ads": -9.0, "advert": -9.0, "adverts": -9.0, "advertisement": -9.0, "advertising": -9.0, "adsense": -9.0, "banner": -9.0, "sponsor": -9.0, "sponsored": -9.0,
             "nav": -9.0, "navbar": -9.0, "navigation": -9.0, "menu": -9.0, "breadcrumb": -9.0, "breadcrumbs": -9.0, "sidebar": -9.0, "footer": -9.0, "masthead": -9.0,
             "comment": -9.0, "comments": -9.0, "reply": -9.0, "replies": -9.0, "responses": -9.0, "discussion": -9.0, "discussions": -9.0, "respond": -9.0, "disqus": -9.0,
             "cookie": -9.0, "cookies": -9.0, "consent": -9.0, "gdpr": -9.0, "popup": -9.0, "modal": -9.0, "overlay": -6.0,
             "newsletter": -9.0, "subscribe": -9.0, "signup": -9.0, "breaking": -3.0, "pagination": -9.0, "pager": -9.0, "copyright": -9.0, "toolbar": -9.0, "complementary": -9.0, "contentinfo": -9.0}
#: Words that name an article's subject as well as a part of a page.
SOFT_ODDS = {"header": -4.0, "notice": -9.0, "promo": -9.0, "login": -9.0, "share": -9.0, "sharing": -9.0, "social": -9.0, "related": -9.0, "recommended": -9.0, "widget": -6.0,
             "legal": -6.0, "disclaimer": -6.0, "search": -9.0, "alert": -6.0, "meta": -3.0, "tags": -6.0, "author": -2.0}
#: Two words side by side in one name.
PAIR_ODDS = {("site", "info"): -9.0, ("site", "header"): -9.0, ("site", "footer"): -9.0, ("skip", "link"): -9.0, ("read", "more"): -6.0, ("user", "notes"): -9.0, ("guest", "book"): -9.0}
LINK_ODDS = -4.0
LENGTH_ODDS = 0.25
#: Capacity of an edge between neighbouring blocks, and between blocks of one parent.
NEXT_EDGE, PARENT_EDGE = 0.6, 0.4


@dataclass
class Block:
    text: str
    odds: float
    parent: int


@dataclass
class _Element:
    name: str
    silent: bool
    number: int
    inside: bool  # within article or main
    box: int  # number of the innermost element here that is not inline


@dataclass
class _Node:
    """An element as the classifier sees it; its number is its place in the page's list."""

    name: str
    above: int
    odds: float  # all its own
    plain: float  # without the boilerplate words of its names
    main: bool
    firm: float  # without the soft ones of them


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    linked: int = 0
    shown: int = 0


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_NO_DISPLAY.search(attributes.get("style", "")))
    )


def _names_odds(attributes: dict[str, str]) -> tuple[float, float, float]:
    """Sums of the positive, the negative and the soft negative log odds of the words in class, id and role."""
    good = bad = soft = 0.0
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").split():
            words = [w.lower() for w in _PARTS.findall(name)]
            for odds in [*(WORD_ODDS.get(w, 0.0) for w in words), *(PAIR_ODDS.get(pair, 0.0) for pair in zip(words, words[1:]))]:
                good, bad = good + max(0.0, odds), bad + min(0.0, odds)
            soft += sum(SOFT_ODDS.get(w, 0.0) for w in words)
    return good, bad, soft


def _sums(nodes: list[_Node], plain: set[int], firm: set[int] | range = frozenset()) -> list[float]:
    """Log odds of each element with those around it; in ``plain`` boilerplate words do not count, in ``firm`` no soft ones."""
    out: list[float] = []
    for i, node in enumerate(nodes):
        out.append((out[node.above] if i else BIAS) + (node.plain if i in plain else node.firm if i in firm else node.odds))
    return out


def _element_odds(nodes: list[_Node], blocks: list[Block]) -> list[float]:
    """Log odds of each element, names of wrappers left out; ``blocks`` have their own odds only."""
    main = {i for i, node in enumerate(nodes) if node.main}
    # An element comes after those around it.
    for i in range(len(nodes) - 1, 0, -1):
        if i in main:
            main.add(nodes[i].above)
    if all(node.odds == node.plain for i, node in enumerate(nodes) if i not in main):
        return _sums(nodes, main)

    def held(sums: list[float]) -> list[int]:
        """Characters of content blocks in each element."""
        chars = [0] * len(nodes)
        for b in blocks:
            if sums[b.parent] + b.odds > 0:
                chars[b.parent] += len(b.text)
        for i in range(len(nodes) - 1, 0, -1):
            chars[nodes[i].above] += chars[i]
        return chars

    def around(of: list[int]) -> set[int]:
        out: set[int] = set()
        for i in of:
            while (i := nodes[i].above) and i not in out:
                out.add(i)
        return out

    articles = [i for i, node in enumerate(nodes) if node.name == "article" and node.odds > 0]
    heads = [i for i, node in enumerate(nodes) if node.name == "h1"]
    if not articles and not heads and not main:
        chars = held(_sums(nodes, main, range(len(nodes))))
        return _sums(nodes, main, {i for i, node in enumerate(nodes) if node.firm > node.odds and 2 * chars[i] > chars[0]})
    chars = held(_sums(nodes, main | around(articles + heads)))
    wrappers = around([max(articles, key=chars.__getitem__)] if articles else []) | around(heads)
    return _sums(nodes, main | {i for i in wrappers if 2 * chars[i] > chars[0]})


class _Stack:
    """Open elements, with the places of each name and of the fences, so that no end tag walks the stack."""

    def __init__(self) -> None:
        self.items = [_Element("", False, 0, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.fences = [0]
        self.links = 0

    def push(self, e: _Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.items))
        if e.name in _FENCE:
            self.fences.append(len(self.items))
        self.links += e.name == "a"
        self.items.append(e)

    def last(self, name: str) -> int:
        """Place of the innermost open ``name`` that an end tag reaches, or 0."""
        place = (self.places.get(name) or [0])[-1]
        return place if name in _FENCE or place > self.fences[-1] else 0

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while place and len(self.items) > place:
            e = self.items.pop()
            self.places[e.name].pop()
            self.links -= e.name == "a"
            if self.fences[-1] == len(self.items):
                self.fences.pop()


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order with their log odds for content."""
    state, stack, nodes = _Page(), _Stack(), [_Node("", 0, 0.0, 0.0, False, 0.0)]

    def close_block() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(state.words))).strip() if state.words else ""
        if text:
            share = state.linked / max(1, state.shown)
            odds = LINK_ODDS * share + LENGTH_ODDS * min(8.0, len(text) ** 0.5 / 3)
            state.blocks.append(Block(text, odds, stack.items[-1].box))
        state.words, state.linked, state.shown = [], 0, 0

    def text_here(text: str) -> None:
        if text and not stack.items[-1].silent:
            state.words.append(text)
            n = len(text.strip())
            state.shown += n
            if stack.links:
                state.linked += n

    at, end = 0, len(page)
    while at < end:
        mark = _MARK.search(page, at)
        if mark is None:
            text_here(page[at:])
            break
        text_here(page[at : mark.start()])
        at = mark.end()
        name = (mark.group(2) or "").lower()
        if not name or not mark.group(4):  # a tag cut off by the end of the page shows nothing
            continue
        if mark.group(1):
            if name not in _INLINE:
                close_block()
            stack.close(stack.last(name))
            continue
        if name == "br":
            text_here(" ")
            continue
        written = mark.group(3) or ""
        if name not in _INLINE:
            close_block()
            # A block closes an open paragraph, and inline elements left open in it.
            place = max(stack.last(x) for x in ("p", *_CLOSES.get(name, ())))
            stack.close(place if place > stack.fences[-1] else 0)
        if name in _VOID or written.endswith("/") and name in ("svg", "path"):
            continue
        if name in _RAW:
            over = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else end
            continue
        above, attributes = stack.items[-1], _attributes(written) if written else {}
        own = TAG_ODDS.get(name, 0.0)
        if name == "header" and above.inside:
            own = -0.5  # an article's own heading
        good, bad, soft = _names_odds(attributes) if name not in ("html", "body") else (0.0, 0.0, 0.0)
        silent = above.silent or name in _SILENT or _hidden(attributes)
        main = name == "main" or "main" in attributes.get("role", "").lower().split()
        number = len(nodes)
        stack.push(_Element(name, silent, number, above.inside or name in ("article", "main"), above.box if name in _INLINE else number))
        nodes.append(_Node(name, above.number, max(-9.0, own + good + bad + soft), max(-9.0, own + good), main, max(-9.0, own + good + bad)))
    close_block()
    sums = _element_odds(nodes, state.blocks)
    for b in state.blocks:
        b.odds += sums[b.parent]
    return state.blocks


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side (content) of the minimum cut.

    A node's two terminal costs come down to their difference: an arc from
    the source where content is cheaper, to the sink otherwise.  Flow is
    pushed along shortest paths by levels (Dinic)."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, v in enumerate(odds):
        if v > 0:
            arc(source, i, v, 0.0)
        elif v < 0:
            arc(i, sink, -v, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(i for i, e in enumerate(path) if room[e] <= tiny)
                del path[keep:]
                a = to[path[-1]] if path else source
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def label(blocks: list[Block]) -> list[bool]:
    """Content or boilerplate, for each block."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_EDGE))
        j = last.get(b.parent)
        if j is not None:
            edges.append((j, i, PARENT_EDGE))
        last[b.parent] = i
    return min_cut([b.odds for b in blocks], edges)


def extract(page: str) -> str:
    """Main text of one page: content blocks joined by an empty line."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([extract(x) for x in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages``."""
    python_ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
