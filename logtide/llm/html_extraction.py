"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. Each block has its word count
and link density, those of its neighbours, whether it is a heading, and the
nearest landmark around it: an element that HTML or its class, id or role
marks as content or as something else. A decision tree trained on LABELLED
(Gini splits, like CART) tells the article's blocks from the rest.

Defined results
    * null html: as an empty page, whose text is empty.
    * character references are decoded; white space inside a block becomes
      one space; blocks are joined by one line feed; ``<br>`` is white space.
    * an unclosed comment, script or style runs to the page's end; a tag that
      doesn't end is text from its ``<`` on. Broken markup takes linear time.
    * very long pages are read whole.
    * repeated rows are read alike; empty tables give no rows; columns that
      are not asked for do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words of class, id and role names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes "
    "noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th "
    "thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset(("script", "style"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(
    "aside button dialog footer form head header iframe menu nav noscript object search select svg template textarea "
    "title".split())
CONTENT_ROLES = frozenset(("article", "main"))
OTHER_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown footer footnav "
    "form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification outbrain "
    "overlay pager pagination paywall popup privacy promo promoted promotion recommended related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar "
    "tooltip topbar warning widget".split())
CONTENT_WORDS = frozenset("article articlebody article-body entry-content post-content post-body story-body "
                          "main-content content post entry story".split())
#: Of an ``<article>``'s own names, only these count against it.
NOT_ARTICLES = frozenset("ad ads advert comment comments promo related reply replies sponsored teaser".split())
#: Names with these beginnings say what a page has or lacks, not what an element is.
ABOUT = ("has-", "no-", "with-", "without-", "is-", "js-")

#: The small labelled table: words and link density of a block, of the block
#: before and of the block after; landmark (1 content, 0 none, -1 other);
#: whether the page has a content landmark (0.5 if by class names alone);
#: heading; label (1 article). The same blocks appear under each landmark. Inside
#: content, links beside links are no text; outside a landmark that only a class
#: name makes, size, links and neighbours decide as on pages without one.
_ANY = tuple((n, d, b, db, a, da) for n, d in ((1, 0.0), (3, 1.0), (12, 0.0), (30, 0.5), (90, 0.0))
             for b, db, a, da in ((0, 0.0, 2, 1.0), (2, 1.0, 50, 0.0), (50, 0.0, 8, 0.0), (20, 0.0, 20, 0.0)))
_LINKS = ((4, 1.0, 3, 1.0, 5, 1.0), (2, 1.0, 6, 1.0, 2, 1.0), (9, 1.0, 8, 1.0, 7, 1.0), (3, 1.0, 3, 1.0, 40, 0.0),
          (6, 1.0, 2, 0.0, 5, 1.0), (1, 1.0, 50, 0.0, 2, 1.0), (5, 1.0, 4, 1.0, 0, 0.0), (12, 0.9, 10, 1.0, 20, 0.0),
          (3, 1.0, 45, 0.0, 3, 1.0), (5, 1.0, 12, 0.0, 4, 1.0), (4, 1.0, 80, 0.0, 6, 1.0), (8, 1.0, 20, 0.0, 2, 1.0),
          (3, 1.0, 3, 1.0, 2, 0.0), (4, 1.0, 6, 1.0, 12, 0.0))
_OPEN = (
    (2, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (6, 0.8, 40, 0.0, 5, 1.0, 0, 0, 0, 0), (25, 0.7, 3, 1.0, 22, 0.6, 0, 0, 0, 0),
    (3, 0.5, 2, 1.0, 50, 0.0, 0, 0, 0, 0), (40, 0.5, 30, 0.5, 12, 1.0, 0, 0, 0, 0), (1, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0),
    (90, 0.8, 60, 0.0, 70, 0.0, 0, 0, 0, 0), (12, 0.9, 30, 0.0, 30, 0.0, 0, 0, 0, 0), (4, 0.6, 20, 0.0, 3, 1.0, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0, 0), (8, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 6, 0.0, 0, 0, 0, 0),
    (10, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (14, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 1, 1.0, 0, 0, 0, 0), (13, 0.1, 1, 1.0, 9, 0.0, 0, 0, 0, 0), (6, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0), (9, 0.0, 3, 1.0, 12, 0.0, 0, 0, 0, 0),
    (45, 0.0, 2, 1.0, 8, 0.0, 0, 0, 0, 1), (60, 0.1, 8, 0.0, 70, 0.0, 0, 0, 0, 1), (25, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1),
    (18, 0.0, 22, 0.0, 10, 0.0, 0, 0, 0, 1), (120, 0.2, 50, 0.0, 3, 1.0, 0, 0, 0, 1), (5, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1, 1), (3, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1, 1), (14, 0.0, 25, 0.0, 8, 0.0, 0, 0, 0, 1),
    (9, 0.1, 12, 0.0, 33, 0.0, 0, 0, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (20, 0.3, 90, 0.0, 65, 0.1, 0, 0, 0, 1),
    (22, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (2, 0.0, 18, 0.0, 60, 0.0, 0, 0, 0, 1), (1, 0.0, 30, 0.0, 20, 0.0, 0, 0, 0, 1),
    (35, 0.2, 2, 0.0, 18, 0.0, 0, 0, 0, 1), (50, 0.0, 50, 0.0, 4, 1.0, 0, 0, 0, 1), (11, 0.0, 45, 0.0, 6, 0.0, 0, 0, 0, 1),
    (6, 0.0, 7, 0.0, 40, 0.0, 0, 0, 1, 1), (20, 0.1, 18, 0.0, 22, 0.0, 0, 0, 0, 1),
    (2, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 1), (2, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1),
)
LABELLED = (
    *((*block, 1, 1, 0, int(not (block[1] > 0.75 and max(block[3], block[5]) > 0.75))) for block in _ANY),
    *((*block, 1, 1, 0, 0) for block in _LINKS),
    *((*block, 1, 0.5, 0, int(not (block[1] > 0.75 and max(block[3], block[5]) > 0.75))) for block in _ANY),
    *((*block, -1, 1, 0, 0) for block in _ANY),
    *((*block, -1, 0, 0, 0) for block in _ANY),
    *((*block, 0, 1, 0, 0) for block in _ANY),
    *_OPEN,
    *((*row[:7], 0.5, *row[8:]) for row in _OPEN),
)
#: Documented bounds of the training.
MOST_LABELLED = 200
DEPTH = 8

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|[^<]+|<""",
                   re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


ANGLE = re.compile("<()()")  # with TOKEN's groups
NAME_END = re.compile(r"[\s/>]")


class TagEnds:
    """Which tags of a page end, found once from the page's end backwards, so
    that broken markup costs no search of the rest of the page at every ``<``.

    From any place outside quotes the next quote or ``>`` decides: at ``>`` the
    tag ends; at a quote it goes on behind the next quote of that kind, if any.
    """

    def __init__(self, html: str):
        self.html, self.name_end = html, -1
        self.places = [m.start() for m in re.finditer("[\"'>]", html)]
        self.ends = bytearray(len(self.places) + 1)
        after = {}  # the quote of each kind that was passed last
        for i in range(len(self.places) - 1, -1, -1):
            c = html[self.places[i]]
            self.ends[i] = 1 if c == ">" else self.ends[after[c] + 1] if c in after else 0
            after[c] = i
        self.last = next((self.places[i] for i in range(len(self.places) - 1, -1, -1) if html[self.places[i]] == ">"), -1)

    def none_at(self, at: int) -> bool:
        """Whether no tag, declaration or comment that begins at ``<`` here ends."""
        if at > self.last and not self.html.startswith("<!--", at):
            return True
        start = at + 1 + self.html.startswith("</", at)
        if not self.html[start:start + 1].isalpha():
            return False
        if start > self.name_end:  # names that begin in one run of characters end together
            found = NAME_END.search(self.html, start)
            self.name_end = found.start() if found else len(self.html)
        return not self.ends[bisect_left(self.places, self.name_end)]


class Block(NamedTuple):
    text: str
    words: int
    density: float
    landmark: int
    heading: int


def _marks(tag: str, attributes: str, around: int, articles: int) -> int | None:
    """Landmark that an element makes: 2, 1 (by class name alone), -1, or None where it makes none."""
    names, parts, role = set(), set(), ""
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name in ("class", "id"):
                for part in value.split():
                    low = part.lower()
                    if not low.startswith(ABOUT):
                        names.add(low)
                        parts |= {low, *re.split(r"[-_]+", low), *(x.lower() for x in re.findall("[A-Z]?[a-z]+", part))}
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return -1
            elif name == "itemprop" and value.lower() == "articlebody":
                return 2
    if tag in ("html", "body"):  # page-wide class names say nothing about their blocks
        return None
    if tag == "main" or role == "main":
        return 2
    if tag == "article" or role == "article":
        # an article inside an article is a comment; inside another landmark a teaser
        return -1 if articles > 0 or around < 0 or parts & NOT_ARTICLES else 2
    if parts & OTHER_WORDS and not names & CONTENT_WORDS or role in OTHER_ROLES:
        return -1
    if tag == "header" and around > 0:  # an article's own header holds its title
        return None
    if tag in OTHER_TAGS:
        return -1
    if names & CONTENT_WORDS and around >= 0:
        return max(1, around)
    return None


def blocks_of(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, landmark outside it, articles outside it
    forms: list[int] = []  # depths of the open forms that nothing else marks
    open_tags: Counter = Counter()
    landmark = articles = heading = linked = 0
    parts: list[str] = []
    link_parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = len(text.split(" "))
                inside = len("".join(link_parts).split())
                out.append(Block(text, n, min(1.0, inside / n), landmark, int(heading > 0)))
        parts.clear()
        link_parts.clear()

    def close(tag: str) -> None:
        nonlocal landmark, articles, heading, linked
        while stack:
            name, landmark, articles = stack.pop()
            if forms and forms[-1] == len(stack):
                forms.pop()
            open_tags[name] -= 1
            heading -= name in HEADINGS
            linked -= name == "a"
            if name == tag:
                return

    at, size = 0, len(html)
    ends = None  # looked up from the first broken tag on
    while at < size:
        if ends and html[at] == "<" and ends.none_at(at):
            m = ANGLE.match(html, at)
        else:
            m = TOKEN.match(html, at)
            if not ends and m.end() == at + 1 and html[at] == "<":
                ends = TagEnds(html)
        at = m.end()
        tag = m.group(2)
        if not tag:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                piece = unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if linked:
                    link_parts.append(piece)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK_TAGS:
                end_block()
            if open_tags[tag]:
                close(tag)
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end_block()
            top = stack[-1][0] if stack else ""
            if top == "p" or top == tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                close(top)
        if tag == "a" and open_tags["a"]:
            close("a")
        attributes = m.group(3)
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        # Pages may wrap everything in one form: inside it, content is still found.
        around = 0 if forms and landmark < 0 else landmark
        mark = _marks(tag, attributes, around, articles)
        if tag == "form" and mark == -1 and landmark >= 0:
            forms.append(len(stack))
        stack.append((tag, landmark, articles))
        open_tags[tag] += 1
        heading += tag in HEADINGS
        linked += tag == "a"
        if mark is not None:
            landmark = mark
            articles += tag == "article"
    end_block()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "landmark",
            "page has content", "heading")


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    has = min(1.0, max((b.landmark for b in blocks if b.landmark > 0), default=0) / 2)
    nothing = Block("", 0, 0.0, 0, 0)
    padded = [nothing, *blocks, nothing]
    return [(b.words, b.density, p.words, p.density, n.words, n.density, min(b.landmark, 1), has, b.heading)
            for p, b, n in zip(padded, blocks, padded[2:], strict=False)]


class Node(NamedTuple):
    label: int
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None  # at most the limit
    high: Node | None = None


def grow(rows: list[tuple], depth: int = DEPTH) -> Node:
    """Binary Gini tree; rows end in their label (0 or 1). Of equally good
    splits the first feature and the lowest limit win."""
    ones = sum(r[-1] for r in rows)
    leaf = Node(int(2 * ones >= len(rows)))
    if depth == 0 or ones in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            cost = 0.0
            for side in ([r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]):
                k = sum(r[-1] for r in side)
                cost += 2 * k * (len(side) - k) / len(side)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit)
    if best is None:
        return leaf
    _, f, limit = best
    return Node(leaf.label, f, limit, grow([r for r in rows if r[f] <= limit], depth - 1),
                grow([r for r in rows if r[f] > limit], depth - 1))


def train(labelled: tuple[tuple, ...] = LABELLED) -> Node:
    if not 0 < len(labelled) <= MOST_LABELLED:
        raise ValueError(f"give 1 to {MOST_LABELLED} labelled blocks")
    return grow([tuple(r) for r in labelled])


def decide(tree: Node, row: tuple[float, ...]) -> int:
    while tree.low is not None:
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree.label


def main_text(html: str | None, tree: Node) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html",
            labelled: tuple[tuple, ...] = LABELLED) -> DataFrame:
    """``keys``, text and n_chars (code points) of every row."""
    tree = train(labelled)
    rows = pages.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(html).alias("html"))
    types = [rows.schema[f"key_{i}"].dataType.simpleString() for i in range(len(keys))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), tree) for value in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    shape = ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, types, strict=True)), "text string", "n_chars long"])
    return rows.mapInArrow(read, shape)
