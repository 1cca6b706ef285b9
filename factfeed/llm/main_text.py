"""Main text of HTML pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block has
its word count and link density, those of its two neighbours, how strongly the
elements around it are marked as page furniture, and whether it stands in an article
and in a heading. A decision tree, grown by Gini impurity on the small labelled table
below, says which blocks are main text.

A mark is strong if a tag or a whole name says furniture ("sidebar", "google-ads",
"menu-item"), and weak if the name only begins with such a word ("side-effects",
"share-prices"). Marks of the whole page, and those around a <main> or an article
with its own <h1>, count for nothing.

Null and empty pages, and pages without such a block, give an empty text. Markup
that breaks off counts as running to the page's end; a quote that is never closed
does not, its tag ends at the next ">". End tags that may be left out are supplied. Repeated pages are read each.
Very long pages are read whole, in time linear in their length. Other columns of
the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

# Element names of HTML by what they do to text, and names that sites
# give to parts of a page.
RAW = "script style noscript title iframe textarea"
DROPPED = "template svg math head object select button"
HEAD = "head base basefont bgsound link meta noframes noscript script style template title"
BREAKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul"
)
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small span "
    "strike strong sub sup time tt u var"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
HEADINGS = "h1 h2 h3 h4 h5 h6"
FURNITURE_TAGS = "nav aside footer form menu dialog"
FURNITURE_WORD = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|sidebar|side|widget|related|recommend\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|disqus|reply|replies|share|social|login|signup|search|toolbar|pagination|pager|complementary|contentinfo|copyright"
)
PLAIN_WORDS = (
    "area bar bars block body bottom box btn button buttons card col column container content count cta desktop fixed "
    "form group holder icon icons inline inner item items large left link links list media mobile module outer page "
    "panel policy post posts region right root row section site slot small sticky text thread title top unit user wide "
    "wrap wrapper zone"
)
OWN_HEADER = "article content entry post story title"
WITHOUT = "has hide no with without"

RAW, DROPPED, HEAD, BREAKS, INLINE, VOID, HEADINGS, FURNITURE_TAGS, PLAIN_WORDS, OWN_HEADER, WITHOUT = (
    frozenset(names.split())
    for names in (RAW, DROPPED, HEAD, BREAKS, INLINE, VOID, HEADINGS, FURNITURE_TAGS, PLAIN_WORDS, OWN_HEADER, WITHOUT)
)
# A start tag closes an open element of these names, unless one of the second stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}

# Possessive, so that no part of a page is read again and again.
NAME = re.compile(r"[^ \t\n\f\r/>]++")
BETWEEN = re.compile(r"[ \t\n\f\r/]*+")
ATTRIBUTE = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)([ \t\n\f\r]*+=[ \t\n\f\r]*+)?")
BARE = re.compile(r"[^ \t\n\f\r>]*+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark", "article", "heading")

# Labelled blocks, the tree's training table: the nine features in order (mark: 0 none, 1 weak,
# 2 strong), then 1 for main text. Written by hand after kinds of blocks that pages commonly have.
LABELLED = (
    (60, 0.0, 8, 0.0, 55, 0.0, 0, 1, 0, 1),
    (120, 0.02, 60, 0.0, 40, 0.0, 0, 1, 0, 1),
    (35, 0.1, 120, 0.0, 80, 0.0, 0, 1, 0, 1),
    (4, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1),
    (1, 0.0, 40, 0.0, 12, 0.0, 0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0, 1),
    (9, 0.0, 7, 0.0, 50, 0.0, 0, 1, 1, 1),
    (6, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 1),
    (14, 0.0, 2, 1.0, 3, 0.0, 0, 1, 1, 1),
    (12, 0.3, 90, 0.0, 30, 0.0, 0, 1, 0, 1),
    (25, 0.0, 30, 0.0, 10, 0.0, 0, 1, 0, 1),
    (300, 0.01, 9, 0.0, 5, 0.0, 0, 1, 0, 1),
    (18, 0.0, 3, 1.0, 8, 0.0, 0, 1, 0, 1),
    (5, 1.0, 40, 0.0, 45, 0.0, 0, 1, 0, 1),
    (8, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1, 1),
    (50, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (70, 0.0, 60, 0.0, 6, 1.0, 0, 1, 0, 1),
    (15, 0.0, 20, 0.0, 3, 1.0, 0, 1, 0, 1),
    (2, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0, 1),
    (30, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1),
    (4, 0.0, 4, 0.0, 3, 1.0, 0, 1, 0, 1),
    (55, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0),
    (4, 0.9, 3, 1.0, 5, 1.0, 0, 1, 0, 0),
    (70, 0.0, 6, 0.0, 65, 0.0, 0, 0, 0, 1),
    (45, 0.05, 70, 0.0, 90, 0.0, 0, 0, 0, 1),
    (30, 0.0, 40, 0.0, 2, 0.0, 0, 0, 0, 1),
    (110, 0.1, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (22, 0.0, 85, 0.0, 60, 0.0, 0, 0, 0, 1),
    (8, 0.0, 75, 0.0, 66, 0.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1),
    (10, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0),
    (3, 0.7, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (5, 1.0, 70, 0.0, 4, 1.0, 0, 0, 0, 0),
    (20, 0.8, 15, 0.9, 12, 1.0, 0, 0, 0, 0),
    (6, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0),
    (4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 5, 0.4, 0, 0, 0, 0),
    (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0),
    (7, 0.2, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (12, 0.0, 40, 0.0, 0, 0.0, 2, 0, 0, 0),
    (8, 0.0, 2, 1.0, 9, 0.0, 2, 0, 0, 0),
    (60, 0.0, 1, 1.0, 10, 0.0, 2, 0, 0, 0),
    (90, 0.1, 50, 0.0, 70, 0.0, 2, 0, 0, 0),
    (25, 0.0, 80, 0.0, 30, 0.0, 2, 0, 0, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 2, 0, 0, 0),
    (1, 1.0, 1, 1.0, 20, 0.0, 2, 0, 0, 0),
    (5, 0.0, 0, 0.0, 2, 1.0, 2, 0, 1, 0),
    (40, 0.0, 60, 0.0, 70, 0.0, 2, 1, 0, 0),
    (6, 0.5, 80, 0.0, 40, 0.0, 2, 1, 0, 0),
    (4, 0.0, 90, 0.0, 12, 0.0, 2, 1, 1, 0),
    (100, 0.0, 20, 0.0, 30, 0.0, 2, 1, 0, 0),
    (1, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 45, 0.0, 0, 0, 1, 1),
    (2, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1, 1),
    (3, 0.0, 5, 1.0, 20, 0.0, 0, 0, 1, 1),
    (1, 0.0, 60, 0.0, 2, 1.0, 0, 0, 1, 0),
    (2, 0.0, 30, 0.0, 4, 1.0, 0, 0, 1, 0),
    (40, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0, 1),
    (18, 0.0, 50, 0.0, 30, 0.0, 1, 1, 0, 1),
    (90, 0.02, 0, 0.0, 40, 0.0, 1, 1, 0, 1),
    (12, 0.0, 8, 0.0, 60, 0.0, 1, 1, 0, 1),
    (5, 0.0, 60, 0.0, 80, 0.0, 1, 1, 1, 1),
    (4, 0.8, 60, 0.0, 5, 1.0, 1, 1, 0, 0),
    (3, 1.0, 4, 1.0, 3, 1.0, 1, 1, 0, 0),
    (10, 0.6, 80, 0.0, 6, 1.0, 1, 1, 0, 0),
    (70, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1),
    (45, 0.05, 2, 1.0, 60, 0.0, 1, 0, 0, 1),
    (25, 0.0, 80, 0.0, 60, 0.0, 1, 0, 0, 1),
    (18, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 1),
    (13, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 1),
    (40, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 4, 0.0, 1, 0, 0, 0),
    (15, 0.7, 3, 1.0, 3, 1.0, 1, 0, 0, 0),
)


class Node(NamedTuple):
    feature: int  # -1: a leaf
    threshold: float
    low: int
    high: int
    main: bool


def grow_tree(table, depth: int = 6, least: int = 1) -> list[Node]:
    """A binary tree by Gini impurity; the first of equal splits wins."""
    data = np.array(table, float)
    nodes: list[Node] = []

    def impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return len(y) * 2 * p * (1 - p)

    def grow(rows: np.ndarray, left: int) -> int:
        x, y = rows[:, :-1], rows[:, -1]
        here = len(nodes)
        nodes.append(Node(-1, 0.0, 0, 0, bool(y.mean() > 0.5)))
        best = None
        if left and 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if least <= low.sum() <= len(y) - least:
                        worth = impurity(y[low]) + impurity(y[~low])
                        if best is None or worth < best[0] - 1e-12:
                            best = (worth, f, cut, low)
        if best is not None and best[0] < impurity(y) - 1e-12:
            _, f, cut, low = best
            a = grow(rows[low], left - 1)
            b = grow(rows[~low], left - 1)
            nodes[here] = Node(f, float(cut), a, b, nodes[here].main)
        return here

    grow(data, depth)
    return nodes


def is_main(tree: list[Node], x: tuple) -> bool:
    node = tree[0]
    while node.feature >= 0:
        node = tree[node.low if x[node.feature] <= node.threshold else node.high]
    return node.main


class Block(NamedTuple):
    text: str
    words: int
    links: float
    mark: int  # 0 none, 1 weak, 2 strong
    article: bool
    heading: bool


class Element:
    """An open element, its mark and where that began."""

    __slots__ = ("tag", "grade", "named", "number", "start", "article", "open")

    def __init__(self, tag: str, grade: int, named: bool, number: int, start: int, article: bool):
        self.tag, self.grade, self.named, self.number, self.start = tag, grade, named, number, start
        self.article, self.open = article, True


class Reader:
    """Collects text blocks from tags and texts in page order."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []  # of the block at hand, and whether each is a link's
        self.begun = False  # whether it has a word
        self.flags = (False, False)
        self.stack: list[Element] = []
        self.where = defaultdict(list)  # places in the stack by name
        self.barriers: list[int] = []  # and of block elements
        self.headings = self.articles = self.dropped = self.opened = 0
        self.headed = -1  # the latest <main>, or article with an <h1>, by order of opening
        self.marks: list[tuple[int, int, int]] = []  # grade, first and last block
        self.grades: dict[tuple[str, bool], int] = {}  # of names met before

    def text(self, text: str) -> None:
        text = html.unescape(text)
        if not text:
            return
        word = not text.isspace()
        if word and self.where["head"]:
            self.leave(self.where["head"][-1])
        if self.dropped:
            return
        if word and not self.begun:
            self.begun = True
            self.flags = (self.articles > 0, self.headings > 0)
        self.parts.append((text, bool(self.where["a"])))

    def cut(self) -> None:
        """Ends the block at hand."""
        if self.begun:
            text = " ".join("".join(p for p, _ in self.parts).split())
            words = text.count(" ") + 1
            linked = sum(len(p.split()) for p, link in self.parts if link)
            self.blocks.append(Block(text, words, min(1.0, linked / words), 0, *self.flags))
        self.parts.clear()
        self.begun = False

    def leave(self, depth: int) -> None:
        """Closes the elements from this depth of the stack on."""
        here = len(self.blocks) + self.begun
        while len(self.stack) > depth:
            e = self.stack.pop()
            if self.barriers and self.barriers[-1] == len(self.stack):
                self.barriers.pop()
            if e.open:
                self.where[e.tag].pop()
            self.headings -= e.tag in HEADINGS
            self.articles -= e.article
            self.dropped -= e.tag in DROPPED
            if e.grade and not (e.named and self.headed > e.number):
                self.marks.append((e.grade, e.start, here))

    def start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        where = self.where
        if where["head"] and tag not in HEAD:
            self.leave(where["head"][-1])
        if tag in BREAKS:
            self.cut()
            if where["p"] and not self.dropped:
                self.leave(where["p"][-1])
        if tag in CLOSES and not self.dropped:
            names, between = CLOSES[tag]
            last = max((where[t][-1] for t in names if where[t]), default=-1)
            if last > max((where[t][-1] for t in between if where[t]), default=-1):
                self.leave(min(d for d in (where[t][-1] for t in names if where[t]) if d >= last))
        if tag == "br":
            self.parts.append((" ", False))
        if tag in VOID:
            return
        if tag == "a":
            self.end("a")
        self.opened += 1
        grade, named = (0, True) if tag in ("html", "body") else furniture(tag, attributes, self.articles > 0, self.grades)
        body = tag == "main" or ("role", "main") in attributes
        if body:
            self.headed = self.opened
        elif tag == "h1" and where["article"]:
            self.headed = max(self.headed, self.stack[where["article"][-1]].number)
        depth = len(self.stack)
        if tag in BREAKS:
            self.barriers.append(depth)
        where[tag].append(depth)
        self.stack.append(Element(tag, grade, named, self.opened, len(self.blocks) + self.begun, body or tag == "article"))
        self.headings += tag in HEADINGS
        self.articles += body or tag == "article"
        self.dropped += tag in DROPPED

    def end(self, tag: str) -> None:
        """An end tag closes what is open inside its element; that of an inline
        element does not reach beyond a block."""
        if tag in BREAKS:
            self.cut()
        if tag == "br":
            self.parts.append((" ", False))
        if not self.where[tag]:
            return
        depth = self.where[tag][-1]
        if tag in INLINE and self.barriers and self.barriers[-1] > depth:
            if tag == "a":  # the link ends, what is around it stays
                self.where[tag].pop()
                self.stack[depth].open = False
            return
        self.leave(depth)

    def finish(self) -> list[Block]:
        self.cut()
        self.leave(0)
        change = [[0] * (len(self.blocks) + 2) for _ in range(3)]
        for grade, start, stop in self.marks:
            change[grade][start] += 1
            change[grade][max(start, stop)] -= 1
        weak, strong, out = 0, 0, []
        for i, b in enumerate(self.blocks):
            weak += change[1][i]
            strong += change[2][i]
            out.append(b._replace(mark=2 if strong else 1 if weak else 0))
        return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, white space made single. Reads a page once."""
    reader, at, end = Reader(), 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    texts_from = 0
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= end:
            break
        mark = page[at + 1]
        closing = mark == "/"
        first = page[at + 1 + closing : at + 2 + closing]
        letter = first.isascii() and first.isalpha()
        if not (letter or closing or mark in "!?"):
            at += 1  # a character of the text
            continue
        reader.text(page[texts_from:at])
        if not letter:
            if page.startswith("<!--", at):
                shut = page.find("-->", at + 2)
                at = shut + 3 if shut >= 0 else end
            else:
                shut = page.find(">", at + 1)
                at = shut + 1 if shut >= 0 else end
        else:
            name = NAME.match(page, at + 1 + closing)
            tag = name[0].lower()
            attributes, at = read_attributes(page, name.end(), last)
            if closing:
                reader.end(tag)
            elif tag in RAW:
                shut = re.compile(rf"</{tag}(?=[ \t\n\f\r/>]|\Z)[^>]*+>?", re.I).search(page, at)
                at = shut.end() if shut else end
            elif not (tag in ("svg", "math") and page[at - 2 : at] == "/>"):
                reader.start(tag, attributes)
        texts_from = at
    reader.text(page[texts_from:])
    return reader.finish()


def read_attributes(page: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """Names and values of a tag's attributes, and where the tag ends. `last` has the
    last place of each quote: one there is never closed."""
    found = []
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= len(page):
            return found, len(page)
        if page[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(page, at)
        at, value = m.end(), ""
        if m[2] is not None:
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                shut = page.index(quote, at + 1)
                value, at = page[at + 1 : shut], shut + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.append((m[1].lower(), value))


def furniture(tag: str, attributes: list[tuple[str, str]], article: bool, known: dict[tuple[str, bool], int]) -> tuple[int, bool]:
    """How strongly an element is marked, and whether by a name that may also stand
    for a whole layout. `known` keeps the grades of names."""
    if tag in FURNITURE_TAGS or tag == "header" and not article:
        return 2, tag == "form"
    grade = 0
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return 2, False
        if name == "style" and INVISIBLE.search(value.lower()):
            return 2, False
        if name in ("class", "id", "role"):
            if (value, article) not in known:
                known[value, article] = max((name_grade(v, article) for v in value.split()), default=0)
            grade = max(grade, known[value, article])
    return grade, True


def name_grade(name: str, article: bool) -> int:
    """2 if the noun of a name is furniture, 1 if a word before it is."""
    words = [w for w in re.split("[^a-z]+", CAMEL.sub("-", name).lower()) if w]
    if not words or words[0] in WITHOUT:
        return 0
    noun = len(words) - 1
    while noun and words[noun] in PLAIN_WORDS:
        noun -= 1
    if words[noun] in ("header", "masthead") and (article or not OWN_HEADER.isdisjoint(words)):
        return 0
    if FURNITURE_WORD.fullmatch(words[noun]):
        return 2
    return int(any(FURNITURE_WORD.fullmatch(w) for w in words[:noun]))


def main_text(page: str, tree: list[Node]) -> str:
    found = blocks(page)
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        x = (
            b.words,
            b.links,
            before.words if before else 0,
            before.links if before else 0.0,
            after.words if after else 0,
            after.links if after else 0.0,
            b.mark,
            b.article,
            b.heading,
        )
        if is_main(tree, x):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, table=LABELLED) -> DataFrame:
    """page_id, url, text of every page."""
    tree = grow_tree(table)

    def make():
        def step(batch):
            found = [main_text(p, tree) for p in texts(batch.column(2))]
            return [batch.column(0), batch.column(1), pa.array(found, pa.string())]

        return step

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, make, "page_id: long, url: string, text: string")
