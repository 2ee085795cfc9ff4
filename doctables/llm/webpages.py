"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut at block-level tags. Each block has its words, the share of them inside links, the
same of its neighbours, the text of some more blocks on either side, and whether the elements around
it say what they are for. The tree is grown on the labelled tables below in every task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no text, elements that end a block, and elements
# without content.
_SILENT = "script style noscript template svg math iframe object title textarea select button head audio video canvas".split()
_BLOCK = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Of the silent ones, those that hide all that follows if they are never closed.
_RAW = {"script", "style", "textarea", "iframe"}
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _SILENT}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements, and words in class, id and role, that say that a block is beside the article.
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog"}
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert sidebar nav navbar navigation menu breadcrumb breadcrumbs share sharing social related recommended "
    "recommendations teaser teasers newsletter subscribe subscription signup login footer contentinfo masthead copyright legal "
    "disclaimer pagination pager popup modal overlay widget widgets toolbar skip search complementary paywall tags outbrain taboola".split()
)
# Those of readers' comments, which may be longer than the article.
_COMMENT_WORDS = frozenset("comment comments reply replies respond responses discussion disqus".split())
_MAIN = {"article", "main"}
_MAIN_WORDS = frozenset("article main content post story entry body".split())
# Words that may stand beside them in one name without another meaning: "comment-list", "post-body".
_PLACE_WORDS = frozenset(
    "area bar block body box bottom column container content cta desktop entry form global group header holder inner item items left "
    "links list main mobile outer page panel post primary region right row secondary section site story text title top wrap wrapper "
    "article message messages unit slot children thread".split()
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# The rest of a tag whose values hold the closing sign in quotes; looked for over a bounded distance.
_QUOTED_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUOTED_REACH = 8_192
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
# Share of a page's words from which on an element is the page and not beside it.
_MOST = 0.5


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    main: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


# What an element says of itself.
_NOTHING, _BESIDE, _COMMENTS, _ARTICLE = range(4)


def _named(token: str) -> int:
    """What one name in class, id or role says. All of its parts have to agree: ``comment-list`` says
    comments, ``has-sidebar`` and ``no-ads`` say nothing."""
    parts = [p.lower() for p in _NAME_PARTS.split(token) if p and not p.isdigit()]
    for words, says in ((_COMMENT_WORDS, _COMMENTS), (_ASIDE_WORDS, _BESIDE), (_MAIN_WORDS, _ARTICLE)):
        if any(p in words for p in parts) and all(p in words or p in _PLACE_WORDS for p in parts):
            return says
    return _NOTHING


def _purpose(name: str, attrs: str, in_main: bool) -> int:
    says = {
        says for m in (_ATTRIBUTE.finditer(attrs) if attrs else ()) for token in (m[2] or m[3] or m[4] or "").split() if (says := _named(token))
    }
    if name in ("body", "html"):
        return _NOTHING
    if _COMMENTS in says:
        return _COMMENTS
    # A header inside the article holds its title.
    if name in _ASIDE or name == "header" and not in_main or _BESIDE in says or attrs and _HIDDEN.search(attrs):
        return _BESIDE
    return _ARTICLE if name in _MAIN or _ARTICLE in says else _NOTHING


@dataclass
class _Element:
    name: str
    says: int
    parent: int
    in_main: bool = False
    words: int = 0


def _marked(elements: list[_Element], blocks: list[tuple[Block, int]]) -> list[Block]:
    """Blocks that know whether they are beside the article or in it.

    What an element says holds for all in it, but not where it cannot be meant: an element around the
    longest article of the page, or one with most of the page's words, is not beside it. Comments may
    have most of the words.
    """
    for block, at in blocks:
        elements[at].words += block.words
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    # Elements come after the ones they are in, so one pass down settles all.
    beside, article = [False] * len(elements), [False] * len(elements)
    inner = [i for i, e in enumerate(elements) if e.says == _ARTICLE and e.name in _MAIN]
    around, at = set(), max(inner, key=lambda i: elements[i].words, default=0)
    while at:
        at = elements[at].parent
        around.add(at)
    for i, e in enumerate(elements):
        if i:
            beside[i], article[i] = beside[e.parent], article[e.parent]
        if e.says in (_BESIDE, _COMMENTS) and i not in around:
            beside[i] |= e.says == _COMMENTS or e.words < _MOST * elements[0].words
        article[i] |= e.says == _ARTICLE and not beside[i]
    for block, i in blocks:
        block.aside, block.main = beside[i], article[i]
    return [block for block, _ in blocks]


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order. Elements that are never closed end with their parent."""
    out: list[tuple[Block, int]] = []
    elements = [_Element("", _NOTHING, 0)]
    stack: list[int] = []
    parts: list[str] = []
    linked: list[str] = []
    link = heading = False

    def flush() -> None:
        nonlocal heading
        words = "".join(parts).split()
        if words:
            inside = "".join(linked).split()
            block = Block(" ".join(words), len(words), min(len(inside), len(words)), False, False, heading)
            out.append((block, stack[-1] if stack else 0))
        parts.clear()
        linked.clear()
        heading = False

    def text(raw: str) -> None:
        if raw:
            decoded = html.unescape(raw)
            parts.append(decoded)
            if link:
                linked.append(decoded)

    def end_of(start: int) -> int:
        """Position after the tag that starts here; the page's end if it is never closed."""
        close = page.find(">", start)
        if close < 0:
            return len(page)
        if '"' in (inside := page[start:close]) or "'" in inside:
            m = _QUOTED_REST.match(page, start, start + _QUOTED_REACH)
            return m.end() if m else close + 1
        return close + 1

    def after(sign: str, start: int) -> int:
        found = page.find(sign, start)
        return len(page) if found < 0 else found + len(sign)

    at, end_of_page = 0, len(page)
    while at < end_of_page:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        if page.startswith("<!--", start):
            at = after("-->", start + 4)
            continue
        if page.startswith("<![CDATA[", start):
            at = after("]]>", start)
            continue
        if page.startswith(("<!", "<?"), start):
            at = after(">", start)
            continue
        tag = _NAME.match(page, start)
        if tag is None:
            text("<")
            at = start + 1
            continue
        name, closes = tag[1].lower(), page[start + 1] == "/"
        at = end_of(tag.end())
        attrs = page[tag.end() : at].rstrip(">")
        if name == "br":
            parts.append(" ")
        elif name in _SILENT:
            if not closes and not attrs.endswith("/"):
                close = _CLOSE[name].search(page, at)
                at = end_of(close.end()) if close else end_of_page if name in _RAW else at
        elif name == "a":
            link = not closes
            linked.append(" ")
        elif name in _BLOCK:
            flush()
            link = False
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if elements[stack[i]].name == name:
                        del stack[i:]
                        break
            elif name not in _VOID:
                if name in ("p", "li") and stack and elements[stack[-1]].name == name:
                    stack.pop()
                parent = stack[-1] if stack else 0
                in_main = elements[parent].in_main
                says = _purpose(name, attrs, in_main)
                elements.append(_Element(name, says, parent, in_main or says == _ARTICLE))
                stack.append(len(elements) - 1)
                heading = name in _HEADINGS
    flush()
    return _marked(elements, out)


# Blocks on either side whose words outside links are summed.
_WIDE = 5
# Labelled tables. Columns: beside the article, in the article, heading, words, link density, words
# and link density of the block before, words and link density of the block after; is article text.
FEATURES = (
    "aside", "main", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after", "text_before", "text_after"
)
_NEAR = np.array(
    [
        # Blocks of elements that say what they are.
        [1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0], [1, 0, 0, 1, 1.0, 1, 1.0, 4, 0.0, 0], [1, 0, 0, 6, 0.0, 1, 1.0, 9, 0.0, 0],
        [1, 0, 0, 40, 0.0, 2, 0.5, 60, 0.0, 0], [1, 0, 0, 120, 0.1, 80, 0.0, 0, 0.0, 0], [1, 1, 0, 25, 0.0, 90, 0.0, 70, 0.0, 0],
        [1, 1, 0, 4, 0.5, 80, 0.0, 60, 0.0, 0], [1, 1, 0, 60, 0.0, 40, 0.0, 0, 0.0, 0], [1, 1, 1, 2, 0.0, 70, 0.0, 30, 0.0, 0],
        [1, 0, 1, 3, 0.0, 10, 0.2, 5, 0.9, 0],
        [0, 1, 1, 8, 0.0, 6, 0.0, 60, 0.0, 1], [0, 1, 1, 3, 0.0, 0, 0.0, 2, 0.0, 1], [0, 1, 1, 9, 1.0, 0, 0.0, 50, 0.0, 1],
        [0, 1, 0, 100, 0.0, 8, 0.0, 80, 0.0, 1], [0, 1, 0, 1, 0.0, 80, 0.0, 1, 0.0, 1], [0, 1, 0, 2, 0.0, 1, 0.0, 9, 0.0, 1],
        [0, 1, 0, 50, 0.2, 40, 0.1, 60, 0.0, 1], [0, 1, 0, 30, 0.5, 90, 0.0, 70, 0.0, 1], [0, 1, 0, 6, 1.0, 70, 0.0, 90, 0.0, 1],
        [0, 1, 0, 20, 0.0, 5, 1.0, 5, 1.0, 1], [0, 1, 0, 4, 0.0, 3, 0.0, 9, 0.0, 1], [0, 1, 0, 3, 1.0, 60, 0.0, 50, 0.1, 1],
        [0, 1, 0, 3, 1.0, 3, 1.0, 3, 1.0, 0], [0, 1, 0, 4, 1.0, 5, 1.0, 2, 1.0, 0], [0, 1, 0, 2, 1.0, 4, 1.0, 8, 1.0, 0],
        [0, 1, 0, 7, 0.9, 6, 1.0, 5, 1.0, 0],
        # Blocks of plain elements: text density and neighbours decide.
        [0, 0, 0, 60, 0.0, 9, 0.0, 70, 0.0, 1], [0, 0, 0, 35, 0.1, 50, 0.0, 40, 0.0, 1], [0, 0, 0, 120, 0.2, 3, 1.0, 90, 0.0, 1],
        [0, 0, 0, 45, 0.0, 80, 0.0, 4, 1.0, 1], [0, 0, 0, 20, 0.0, 60, 0.0, 60, 0.0, 1], [0, 0, 0, 8, 0.0, 40, 0.0, 50, 0.0, 1],
        [0, 0, 0, 2, 0.0, 45, 0.0, 70, 0.0, 1], [0, 0, 0, 25, 0.3, 60, 0.1, 30, 0.0, 1], [0, 0, 0, 40, 0.3, 30, 0.0, 20, 0.3, 1],
        [0, 0, 1, 7, 0.0, 3, 1.0, 60, 0.0, 1], [0, 0, 1, 4, 0.0, 50, 0.0, 45, 0.0, 1], [0, 0, 1, 9, 0.0, 0, 0.0, 30, 0.0, 1],
        [0, 0, 1, 3, 0.0, 4, 1.0, 2, 1.0, 0], [0, 0, 1, 2, 0.0, 8, 0.0, 4, 1.0, 0], [0, 0, 1, 3, 0.0, 40, 0.0, 5, 0.9, 0],
        [0, 0, 0, 3, 1.0, 2, 1.0, 4, 1.0, 0], [0, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0], [0, 0, 0, 8, 0.8, 5, 1.0, 9, 0.7, 0],
        [0, 0, 0, 30, 0.9, 20, 0.8, 25, 0.9, 0], [0, 0, 0, 50, 0.7, 60, 0.0, 8, 0.5, 0], [0, 0, 0, 5, 0.0, 3, 1.0, 4, 1.0, 0],
        [0, 0, 0, 9, 0.0, 4, 0.9, 2, 0.0, 0], [0, 0, 0, 6, 0.3, 5, 0.6, 0, 0.0, 0], [0, 0, 0, 7, 0.0, 50, 0.0, 3, 1.0, 0],
        [0, 0, 0, 4, 0.0, 9, 0.0, 6, 0.0, 0], [0, 0, 0, 10, 0.0, 70, 0.0, 0, 0.0, 0], [0, 0, 0, 12, 0.5, 8, 0.4, 6, 0.6, 0],
        [0, 0, 0, 3, 1.0, 2, 1.0, 60, 0.0, 0], [0, 0, 0, 2, 1.0, 0, 0.0, 40, 0.0, 0], [0, 0, 0, 8, 0.9, 5, 1.0, 80, 0.0, 0],
        [0, 0, 0, 40, 0.8, 50, 0.0, 60, 0.0, 0], [0, 0, 0, 70, 0.0, 60, 0.0, 0, 0.0, 1], [0, 0, 0, 40, 0.0, 3, 1.0, 2, 1.0, 1],
        [0, 0, 0, 60, 0.1, 60, 0.0, 5, 1.0, 1], [0, 0, 0, 90, 0.0, 0, 0.0, 4, 0.9, 1], [0, 0, 0, 9, 0.0, 0, 0.0, 3, 1.0, 0],
        [0, 0, 0, 55, 0.6, 2, 1.0, 70, 0.0, 0], [0, 0, 0, 30, 0.0, 60, 0.0, 5, 0.0, 1], [0, 0, 0, 5, 0.0, 0, 0.0, 60, 0.0, 0],
    ],
    dtype=np.float64,
)
# Short plain blocks: words, words and link density of the block before, of the block after, words
# outside links in the five blocks before and after; is article text.
_SHORT = np.array(
    [
        # Among text, whatever the size of the next blocks.
        [8, 8, 0.0, 17, 0.0, 60, 60, 1], [2, 2, 0.0, 2, 0.0, 40, 30, 1], [1, 9, 0.0, 1, 0.0, 50, 40, 1], [7, 8, 0.0, 7, 0.0, 25, 25, 1],
        [3, 60, 0.0, 4, 0.0, 200, 90, 1], [12, 5, 0.0, 9, 0.0, 30, 35, 1], [4, 6, 0.0, 40, 0.0, 22, 45, 1], [15, 3, 0.0, 2, 0.0, 90, 120, 1],
        # The article's last block, with a line of the footer behind it, and its first ones.
        [9, 13, 0.0, 9, 0.0, 80, 9, 1], [4, 13, 0.0, 8, 0.0, 70, 8, 1], [2, 10, 0.0, 12, 0.0, 45, 12, 1], [6, 30, 0.0, 7, 0.0, 100, 7, 1],
        [6, 9, 0.0, 3, 0.0, 9, 120, 1], [4, 12, 0.0, 25, 0.0, 12, 150, 1], [3, 6, 0.0, 3, 0.0, 9, 95, 1], [8, 8, 0.0, 11, 0.0, 8, 130, 1],
        # Between links and text, behind all text, and in small groups.
        [9, 1, 1.0, 5, 0.0, 0, 100, 0], [12, 1, 1.0, 8, 0.0, 0, 60, 0], [4, 2, 1.0, 50, 0.0, 0, 200, 0],
        [7, 50, 0.0, 0, 0.0, 150, 0, 0], [9, 9, 0.0, 0, 0.0, 60, 0, 0], [12, 16, 0.0, 0, 0.0, 40, 0, 0], [8, 90, 0.0, 3, 1.0, 300, 0, 0],
        [4, 9, 0.0, 6, 0.0, 9, 6, 0], [5, 4, 0.0, 3, 0.0, 10, 8, 0], [6, 5, 0.0, 9, 0.0, 4, 12, 0], [3, 2, 0.0, 4, 0.0, 7, 11, 0],
    ],
    dtype=np.float64,
)


def labelled() -> np.ndarray:
    """Both tables with all features: where nothing more is said, the next blocks are all text there is."""
    text = [_NEAR[:, i] * (1 - _NEAR[:, i + 1]) for i in (5, 7)]
    near = np.column_stack([_NEAR[:, :9], *text, _NEAR[:, 9]])
    plain = np.zeros((len(_SHORT), 4))
    short = np.column_stack([plain[:, :3], _SHORT[:, 0], plain[:, 3], _SHORT[:, 1:]])
    return np.concatenate([near, short])


class Tree:
    """A binary decision tree by Gini impurity, grown until every leaf has one label."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.value = float(labels.mean())
        self.split: tuple[int, float] | None = None
        best = None
        if 0 < self.value < 1:
            for column in range(rows.shape[1]):
                for level in np.unique(rows[:, column])[:-1]:
                    low = rows[:, column] <= level
                    parts = [labels[low], labels[~low]]
                    impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
                    if best is None or impurity < best[0] - 1e-12:
                        following = rows[~low, column].min()
                        best = (impurity, column, (level + following) / 2, low)
        if best is not None:
            _, column, level, low = best
            self.split = column, level
            self.low, self.high = Tree(rows[low], labels[low]), Tree(rows[~low], labels[~low])

    def of(self, row: tuple) -> float:
        at = self
        while at.split is not None:
            at = at.low if row[at.split[0]] <= at.split[1] else at.high
        return at.value


# Neighbours that the labels of marked blocks and of long plain text do not depend on.
_NEIGHBOURS = np.array(
    [
        [0, 0, 0, 0, 0, 0], [1, 1, 1, 1, 0, 0], [90, 0, 90, 0, 90, 90], [90, 0, 2, 1, 300, 0], [2, 1, 90, 0, 0, 300], [6, 0, 6, 0, 60, 60],
        [4, 0, 30, 0, 200, 150], [30, 0, 4, 0, 15, 40], [2, 0, 3, 0, 9, 8],
    ],
    dtype=np.float64,
)
# Words of the next blocks, of which short plain blocks among text do not depend either.
_NEXT = np.array([[a, b] for a in (1, 4, 9, 40) for b in (1, 4, 9, 40)], dtype=np.float64)


def grown() -> Tree:
    rows = labelled()
    said = (rows[:, 0] == 1) | (rows[:, 1] == 1)
    marked = rows[said & ~((rows[:, 4] > 0.8) & (rows[:, 6] > 0.8))]
    long = rows[~said & (rows[:, 3] >= 30) & (rows[:, 4] <= 0.2) & (rows[:, 11] == 1)]
    varied = np.repeat(np.concatenate([marked, long]), len(_NEIGHBOURS), axis=0)
    varied[:, 5:11] = np.tile(_NEIGHBOURS, (len(marked) + len(long), 1))
    linked = varied[:, 4] > 0.8  # lists of links are told from single links by their neighbours
    among = rows[~said & (rows[:, 4] == 0) & (rows[:, 9] >= 20) & (rows[:, 10] >= 20) & (rows[:, 11] == 1)]
    shifted = np.repeat(among, len(_NEXT), axis=0)
    shifted[:, [5, 7]] = np.tile(_NEXT, (len(among), 1))
    rows = np.concatenate([rows, varied[~linked | (varied[:, 0] == 1)], shifted])
    return Tree(rows[:, :-1], rows[:, -1])


def features(blocks: list[Block]) -> list[tuple]:
    """A row of ``FEATURES`` per block."""
    none = Block("", 0, 0, False, False, False)
    text = np.cumsum([0, *(b.words - b.linked for b in blocks)]).tolist()
    rows = []
    for i, (before, b, after) in enumerate(zip([none, *blocks], blocks, [*blocks[1:], none])):
        wide = text[i] - text[max(i - _WIDE, 0)], text[min(i + 1 + _WIDE, len(blocks))] - text[i + 1]
        rows.append((b.aside, b.main, b.heading, b.words, b.density, before.words, before.density, after.words, after.density, *wide))
    return rows


def main_text(page: str, tree: Tree) -> str:
    """The article's blocks in page order, joined by one space."""
    blocks = blocks_of(page)
    return " ".join(b.text for b, row in zip(blocks, features(blocks)) if tree.of(row) > 0.5)


def extract(page: Column) -> Column:
    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = grown()
        for pages in batches:
            yield pa.array([main_text(p.as_py(), tree) for p in pages], pa.string())

    return of.asNondeterministic()(page)


def with_main_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """Add the main text of every whole ``html``; a column of that name is replaced.

    A null or empty page, and one without an article, has an empty text. Rows are neither added nor
    dropped; equal pages have equal texts; an empty table stays empty.
    """
    return pages.withColumn(column, extract(F.coalesce(F.col("html").cast("string"), F.lit(""))))
