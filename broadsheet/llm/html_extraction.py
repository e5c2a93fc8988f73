"""Main text of pages by minimum-cut labelling.

A page becomes a list of blocks in page order.  A classifier gives every
block a log-odds of being content: a logistic model of the block's text,
trained here on a bounded sample of blocks whose place is unmistakable, plus
the evidence of its markup, summed over the elements around it.  No tag, class
or attribute decides alone: what a word in a class name says against a block,
its text and its neighbours may say for it.  Log-odds become capacities to the
two terminals, neighbourhood and closeness in the DOM become smoothness edges,
and the minimum cut, found by maximum flow, separates content from boilerplate.

A block is the text between two block-level tags; line breaks are white
space inside it.  Defined results: a NULL or empty page has an empty text.
Unclosed, truncated or misnested markup is read as far as it goes.  Repeated
rows get equal results.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tag names of HTML by role.
UNSEEN = frozenset("script style head title noscript template svg math iframe object canvas audio video textarea select".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q ruby rp rt s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset("nav footer aside button dialog menu fieldset label legend select".split())
CONTENT_TAGS = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
# Words in class and id names.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent copyright disclaimer disqus footer header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice pager pagination paywall popup promo promotion recommended related reply replies respond search share sharing "
    "sidebar signup social sponsor sponsored sponsors subscribe tags teaser toolbar widget".split()
)
CONTENT_WORDS = frozenset("article content entry story post body main text maincontent".split())

#: Log-odds of a block: in an article, beside one, and on a page that marks no article.
ARTICLE_ODDS, BESIDE_ODDS, OPEN_ODDS = 3.0, -2.0, 0.5
#: What elements around it add: a tag of the page's frame, a form, an attribute
#: that hides, a name made of boilerplate words, and one that has such a word.
TAG_ODDS, FORM_ODDS, HIDDEN_ODDS, NAME_ODDS, WORD_ODDS = -6.0, -2.5, -5.0, -4.5, -1.5
LEAST_ODDS = -9.0
#: Of the best block where all would be boilerplate.
SOME_ODDS = 1.0
LINK_ODDS = -4.0
#: The trained part is kept within this range.
TEXT_ODDS = 2.5
#: Smoothness between neighbours, divided by one more than their steps apart in
#: the DOM, and between blocks of one parent that follow one another in it.
NEIGHBOUR, SIBLING = 3.0, 1.5
#: Pages the classifier is trained on, about; and blocks of one page.
SAMPLE_PAGES, SAMPLE_BLOCKS = 1_000, 40
FEATURES = 7

# Quotes count after an equals sign only; without a closing one they are letters.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+{_VALUE})*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(rf"""([^\s"'>/=]++)(?:\s*+=\s*+({_VALUE}))?+""")
_CUT_OFF = re.compile(r"<(?=/?[a-zA-Z])")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Element:
    name: str
    parent: int
    depth: int
    #: The nearest element around a text here that is not inline.
    container: int
    #: Evidence of this element and those around it, and whether one of them is the article.
    odds: float
    content: bool
    unseen: bool

    @property
    def boiler(self) -> bool:
        return self.odds <= NAME_ODDS


@dataclass
class Block:
    element: int
    text: str
    linked: int


def attributes_of(source: str) -> dict[str, str]:
    """Attribute values by lower-case name; the first of a repeated name wins."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), value)
    return found


def _evidence(name: str, attributes: dict[str, str]) -> tuple[float, bool]:
    """Log-odds that the tag itself adds, and whether it marks the article."""
    odds = 0.0
    hides = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
    if hides or _NONE.search(attributes.get("style", "")):
        odds += HIDDEN_ODDS
    if name in BOILER_TAGS:
        return odds + TAG_ODDS, False
    if name == "form":
        odds += FORM_ODDS
    if name in ("body", "html") or name in CONTENT_TAGS:
        return odds, name in CONTENT_TAGS
    words: set[str] = set()
    for key in ("class", "id", "role"):
        if key in attributes:
            words.update(_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes[key]).lower()))
    words.discard("")
    bad, good = words & BOILER_WORDS, words & CONTENT_WORDS
    if good:
        bad -= {"header", "tags", "notice", "related"}  # "post-header" belongs to the article; "ad-text" does not
    if not bad:
        return odds, bool(good)
    # A name of such words alone says more than one word in another name.
    return odds + (NAME_ODDS if bad >= words - good else WORD_ODDS), False


class Page:
    """Blocks and their elements, from one pass over the tags."""

    def __init__(self, html: str):
        self.elements = [Element("", -1, 0, 0, 0.0, False, False)]
        self.blocks: list[Block] = []
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0
        self._read(html)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.elements[self.stack[-1]].container, text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _text(self, raw: str) -> None:
        if raw and not self.elements[self.stack[-1]].unseen:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text)

    def _close(self, name: str) -> None:
        """Close the nearest open tag of that name, and what is open in it."""
        if not self.open[name]:
            return
        while True:
            gone = self.elements[self.stack.pop()].name
            self.open[gone] -= 1
            self.in_link -= gone == "a"
            if gone == name:
                return

    def _open(self, name: str, source: str) -> None:
        if name in CLOSES_P:
            self._close("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if self.elements[self.stack[-1]].name == name:
                self._close(name)
        at = self.stack[-1]
        parent = self.elements[at]
        odds, content = _evidence(name, attributes_of(source) if source else {})
        if name == "header" and not (parent.content and not parent.boiler):
            odds += TAG_ODDS
        around = parent.odds
        if content and not parent.content and around > NAME_ODDS:
            around = 0.0  # an article in a form, or in an oddly named box, is an article
        here = len(self.elements)
        self.elements.append(
            Element(
                name,
                at,
                parent.depth + 1,
                parent.container if name in INLINE else here,
                max(LEAST_ODDS, around + odds),
                parent.content or content,
                parent.unseen or name in UNSEEN,
            )
        )
        self.stack.append(here)
        self.open[name] += 1
        self.in_link += name == "a"

    def _read(self, html: str) -> None:
        at, end = 0, html.rfind(">") + 1
        while True:
            match = _TOKEN.search(html, at, end)
            if match is None:
                break
            self._text(html[at : match.start()])
            at = match.end()
            name = match.group(2)
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE:
                self._flush()
            elif name == "br":
                self._text(" ")
                continue
            if match.group(1):
                self._close(name)
            elif name not in VOID:
                self._open(name, match.group(3) or "")
                if name in RAW:
                    close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
                    at = close.end() if close else len(html)
                    self._close(name)
        rest = html[at:]
        # A tag that the page breaks off in is no text.
        cut_off = _CUT_OFF.search(html, max(at, end))
        self._text(html[at : cut_off.start()] if cut_off else rest)
        self._flush()


def block_features(page: Page) -> np.ndarray:
    """Text features only; where the block stands is not among them."""
    rows = np.zeros((len(page.blocks), FEATURES))
    for i, block in enumerate(page.blocks):
        text, n = block.text, len(block.text)
        words = text.count(" ") + 1
        rows[i] = (
            min(np.log1p(words), 5.0) / 5.0,
            block.linked / n,
            1.0 if text[-1] in ".!?:\"'»”…" else 0.0,
            min(sum(text.count(c) for c in ".,;:!?") / words, 1.0),
            1.0 if page.elements[block.element].name in ("p", "pre", "blockquote", "td", "dd") else 0.0,
            1.0 if page.elements[block.element].name in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0,
            1.0 if "©" in text else 0.0,
        )
    return rows


#: Used while nothing could be learned: no weight on the text.
NEUTRAL = np.zeros(FEATURES + 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, steps: int = 25) -> np.ndarray:
    """Weights and bias by Newton steps."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    weights = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (share * (p - y)) + penalty * weights
        hessian = (rows * (share * p * (1 - p))[:, None]).T @ rows + penalty * np.eye(rows.shape[1])
        weights -= np.linalg.solve(hessian, gradient)
    return weights


def train_blocks(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """The text classifier, from blocks inside an article and blocks inside boilerplate.

    Pages are drawn by the hash of their html; about ``sample_pages`` of them
    and at most ``SAMPLE_BLOCKS`` blocks each come to the driver.
    """
    total = pages.count()
    draw = F.pmod(F.xxhash64(html, F.lit("block sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = pages.select(html).where(F.col(html).isNotNull() & (draw < sample_pages / max(1, total)))

    def examples(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            features, labels = [], []
            for content in columns[html]:
                page = Page(content)
                rows = block_features(page)
                for block, row in list(zip(page.blocks, rows))[:SAMPLE_BLOCKS]:
                    element = page.elements[block.element]
                    if element.boiler != (element.content and element.odds == 0.0):
                        features.append(row.tolist())
                        labels.append(int(not element.boiler))
            if labels:
                yield {"features": features, "label": labels}

    found = map_batches(sample, examples, "features array<double>, label int").collect()
    if len({r["label"] for r in found}) < 2:
        return NEUTRAL
    found.sort(key=lambda r: (r["label"], r["features"]))
    return fit_logistic(np.array([r["features"] for r in found]), np.array([float(r["label"]) for r in found]))


def steps_apart(elements: list[Element], a: int, b: int) -> int:
    """Edges on the DOM path between two elements."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut.

    Positive odds are capacities from the source, negative ones to the sink;
    an edge costs its capacity when it is cut, in either direction.  Maximum
    flow by levels and blocking paths, without recursion.
    """
    n = len(odds)
    source, sink = n, n + 1
    heads: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forward: float, backward: float) -> None:
        out[a].append(len(heads))
        heads.append(b)
        room.append(forward)
        out[b].append(len(heads))
        heads.append(a)
        room.append(backward)

    for i, odd in enumerate(odds):
        if odd > 0:
            add(source, i, odd, 0.0)
        elif odd < 0:
            add(i, sink, -odd, 0.0)
    for a, b, capacity in edges:
        add(a, b, capacity, capacity)
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
        next_edge = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                at = heads[path[first] ^ 1]
                del path[first:]
            while next_edge[at] < len(out[at]):
                e = out[at][next_edge[at]]
                if room[e] > tiny and level[heads[e]] == level[at] + 1:
                    break
                next_edge[at] += 1
            if next_edge[at] < len(out[at]):
                path.append(e)
                at = heads[e]
            elif at == source:
                break
            else:
                level[at] = -1
                e = path.pop()
                at = heads[e ^ 1]


def main_text(html: str | None, weights: np.ndarray = NEUTRAL) -> tuple[str, int, int]:
    """The content blocks joined by line breaks, and how many blocks of how many they are."""
    blocks, content = labelled(html, weights)
    chosen = [block.text for block, inside in zip(blocks, content) if inside]
    return "\n".join(chosen), len(chosen), len(blocks)


def labelled(html: str | None, weights: np.ndarray = NEUTRAL, smooth: bool = True) -> tuple[list[Block], list[bool]]:
    """The blocks of a page and whether each is content; without ``smooth``, by the sign of its own log-odds."""
    if not html:
        return [], []
    page = Page(html)
    blocks, elements = page.blocks, page.elements
    if not blocks:
        return [], []
    learned = np.clip(block_features(page) @ weights[:-1] + weights[-1], -TEXT_ODDS, TEXT_ODDS)
    marked = any(elements[b.element].content and not elements[b.element].boiler for b in blocks)
    odds = []
    for block, text_odds in zip(blocks, learned.tolist()):
        element = elements[block.element]
        odd = element.odds + text_odds
        if element.content:
            odd += ARTICLE_ODDS
        else:
            odd += (BESIDE_ODDS if marked else OPEN_ODDS) + LINK_ODDS * block.linked / len(block.text)
        odds.append(odd)
    free = [i for i, b in enumerate(blocks) if elements[b.element].odds == 0.0]
    if free and max(odds) <= 0:
        # A page has a main text: the best block that no markup speaks against is some of it.
        shift = SOME_ODDS - max(odds[i] for i in free)
        for i in free:
            odds[i] += shift
    edges, last_of = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEIGHBOUR / (1 + steps_apart(elements, blocks[i - 1].element, block.element))))
        parent = elements[block.element].parent
        if parent in last_of and last_of[parent] != i - 1:
            edges.append((last_of[parent], i, SIBLING))
        last_of[parent] = i
    return blocks, minimum_cut(odds, edges) if smooth else [odd > 0 for odd in odds]


def extract_main_text(pages: DataFrame, html: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` without html, with ``text``, ``n_chars``, ``n_content`` and ``n_blocks``.

    Parsing happens in the scan stage; nothing is shuffled.  Columns of
    ``pages`` with one of the new names are replaced.
    """
    model = train_blocks(pages, html) if weights is None else weights
    new = ("text", "n_chars", "n_content", "n_blocks")
    kept = [c for c in pages.columns if c != html and c not in new]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            found = [main_text(content, model) for content in columns[html]]
            yield {
                **{c: columns[c] for c in kept},
                "text": [f[0] for f in found],
                "n_chars": [len(f[0]) for f in found],
                "n_content": [f[1] for f in found],
                "n_blocks": [f[2] for f in found],
            }

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    new_schema = "text string, n_chars long, n_content int, n_blocks int"
    return map_batches(pages.select(*kept, html), run, f"{schema}{', ' if schema else ''}{new_schema}")
