"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its number of words and its link density
(the share of its words inside links), the same of the blocks before and after it, whether it is a heading, and whether
it stands in an article or in an element marked as something else: surely (menu, footer, advert, comments) or perhaps (a form, or a
name such as header, sidebar, share, notice, all of which also stand round whole pages). An article ends the second kind
of mark, a main element every mark but ``hidden``. Names of a state (nav-open, comments-enabled) are no marks. A decision tree, trained
here on the small labelled table below, tells which blocks are main text; they are joined in page order. Scripts, styles, head,
markup comments and form controls never make blocks.

The parser keeps one small record per open element and passes over a page once, so time grows with the page's length
whatever its nesting. Pages are tasks' rows, taken one at a time.

Nulls: a null page is empty and has an empty text; a null id or url stays null. Repeated rows stay, equal pages have equal texts; an
empty table gives no rows. A very long page is parsed whole by one task, in time linear in its length. Only the three named
columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Tags by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split())
SILENT_TAGS = frozenset(
    "head script style title noscript template svg math iframe object audio video canvas select option textarea button "
    "datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_TAGS = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
# Words of a class or id that mark an element as something else than the article, and those that only may.
SURE_NAMES, LOOSE_NAMES = (re.compile(rf"(?:^|[-_])(?:{x})(?:$|[-_])", re.IGNORECASE) for x in (
    r"ad|ads|advert|advertisement|adverts|advertising|breadcrumbs?|comments?|consent|cookies?|discuss"
    r"|disqus|footer|gdpr|login|menu|modal|nav|navbar|navigation|newsletter|notification"
    r"|paywall|popup|related|replies|reply|respond|signup|sponsor|sponsored|subscribe|toolbar",
    r"banner|header|masthead|notices?|promo|promoted|share|sharing|sidebar|social"))
# Names that tell of a page's layout or state, or of the head of its text.
LAYOUT_NAMES = re.compile(r"(?:no|has|with|without)[-_]|(?:\S*[-_])?(?:entry|post|article|story|content|page)[-_]{1,2}header(?:$|[-_])"
                          r"|\S+[-_](?:open|opened|closed|active|inactive|enabled|disabled|visible|expanded|collapsed)$", re.IGNORECASE)
LOOSE, SURE, HIDDEN = 1, 2, 3


def _named(names: str) -> int:
    """The mark that a class and id give."""
    found = 0
    for name in names.split():
        if not LAYOUT_NAMES.match(name):
            found = max(found, SURE if SURE_NAMES.search(name) else LOOSE if LOOSE_NAMES.search(name) else 0)
    return found


# The labelled table: words, link density, words and link density of the block before and of the one after,
# heading, in an article, in an element marked otherwise (1 surely, 0.5 perhaps); main text or not.
LABELLED = [
    (12, 1.00, 0, 0.00, 9, 1.00, 0, 0, 1, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0), (2, 1.00, 1, 1.00, 30, 0.00, 0, 0, 1, 0),
    (8, 0.00, 2, 1.00, 12, 0.00, 0, 0, 1, 0), (25, 0.00, 1, 1.00, 9, 0.00, 0, 0, 1, 0), (90, 0.02, 40, 0.00, 60, 0.00, 0, 0, 1, 0),
    (14, 0.10, 80, 0.00, 0, 0.00, 0, 0, 1, 0), (6, 0.00, 70, 0.00, 4, 1.00, 0, 0, 1, 0), (40, 0.00, 35, 0.00, 45, 0.00, 0, 1, 1, 0),
    (10, 0.00, 100, 0.00, 20, 0.00, 0, 1, 1, 0), (3, 0.00, 50, 0.00, 60, 0.00, 0, 1, 1, 0), (150, 0.00, 90, 0.00, 0, 0.00, 0, 1, 1, 0),
    (5, 0.00, 20, 0.00, 30, 0.00, 1, 0, 1, 0), (4, 1.00, 30, 0.10, 60, 0.00, 1, 0, 1, 0), (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1, 0),
    (9, 0.00, 3, 1.00, 80, 0.00, 1, 1, 0, 1), (3, 0.00, 9, 0.00, 60, 0.00, 1, 1, 0, 1), (60, 0.00, 9, 0.00, 120, 0.00, 0, 1, 0, 1),
    (120, 0.03, 60, 0.00, 2, 0.00, 0, 1, 0, 1), (2, 0.00, 120, 0.00, 80, 0.00, 0, 1, 0, 1), (1, 0.00, 2, 0.00, 1, 0.00, 0, 1, 0, 1),
    (80, 0.00, 1, 0.00, 10, 0.20, 0, 1, 0, 1), (20, 0.30, 80, 0.00, 8, 0.00, 0, 1, 0, 1), (6, 0.50, 90, 0.00, 70, 0.00, 0, 1, 0, 1),
    (4, 1.00, 60, 0.00, 90, 0.00, 0, 1, 0, 1), (1, 1.00, 60, 0.00, 30, 0.00, 0, 1, 0, 1), (7, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1),
    (5, 0.00, 70, 0.00, 8, 1.00, 0, 1, 0, 1), (200, 0.01, 0, 0.00, 0, 0.00, 0, 1, 0, 1), (6, 1.00, 5, 0.00, 50, 0.00, 1, 1, 0, 1),
    (70, 0.00, 6, 0.00, 90, 0.00, 0, 0, 0, 1), (45, 0.05, 70, 0.00, 60, 0.02, 0, 0, 0, 1), (110, 0.10, 45, 0.00, 9, 1.00, 0, 0, 0, 1),
    (30, 0.00, 110, 0.00, 50, 0.00, 0, 0, 0, 1), (18, 0.00, 30, 0.00, 60, 0.00, 0, 0, 0, 1), (8, 0.00, 90, 0.00, 70, 0.00, 0, 0, 0, 1),
    (4, 0.00, 60, 0.00, 80, 0.00, 0, 0, 0, 1), (24, 0.00, 0, 0.00, 40, 0.00, 0, 0, 0, 1), (6, 0.00, 4, 1.00, 70, 0.00, 1, 0, 0, 1),
    (8, 0.00, 60, 0.00, 90, 0.00, 1, 0, 0, 1), (3, 0.00, 2, 1.00, 25, 0.00, 1, 0, 0, 1), (35, 0.00, 8, 0.00, 0, 0.00, 0, 0, 0, 1),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0), (10, 0.90, 8, 1.00, 12, 0.80, 0, 0, 0, 0), (5, 0.80, 80, 0.00, 6, 1.00, 0, 0, 0, 0),
    (1, 1.00, 90, 0.00, 60, 0.00, 0, 0, 0, 0), (15, 0.70, 3, 1.00, 60, 0.00, 0, 0, 0, 0), (4, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (6, 0.00, 5, 1.00, 3, 1.00, 0, 0, 0, 0), (2, 0.00, 0, 0.00, 5, 1.00, 0, 0, 0, 0), (7, 0.20, 4, 1.00, 0, 0.00, 0, 0, 0, 0),
    (30, 0.85, 60, 0.00, 40, 0.90, 0, 0, 0, 0), (5, 1.00, 4, 1.00, 6, 1.00, 1, 0, 0, 0),
    (90, 0.02, 40, 0.00, 60, 0.00, 0, 0, 0.5, 1), (45, 0.00, 80, 0.00, 70, 0.00, 0, 0, 0.5, 1),
    (60, 0.05, 9, 0.00, 60, 0.00, 0, 1, 0.5, 1), (150, 0.00, 6, 0.00, 40, 0.00, 0, 1, 0.5, 1),
    (12, 1.00, 0, 0.00, 9, 1.00, 0, 0, 0.5, 0), (8, 0.00, 2, 1.00, 12, 0.00, 0, 0, 0.5, 0), (2, 1.00, 1, 1.00, 30, 0.00, 0, 0, 0.5, 0),
    (60, 0.90, 3, 1.00, 60, 0.80, 0, 0, 0.5, 0), (10, 0.00, 100, 0.00, 20, 0.00, 0, 1, 0.5, 0), (4, 1.00, 30, 0.10, 60, 0.00, 1, 0, 0.5, 0),
    (2, 0.00, 0, 0.00, 1, 1.00, 0, 0, 0.5, 0), (1, 1.00, 2, 0.00, 0, 0.00, 0, 0, 0.5, 0), (14, 0.10, 80, 0.00, 0, 0.00, 0, 0, 0.5, 0),
    (12, 1.00, 0, 0.00, 120, 0.00, 0, 0, 1, 0), (5, 1.00, 2, 1.00, 100, 0.00, 0, 0, 0.5, 0), (6, 0.00, 2, 0.00, 90, 0.00, 0, 0, 0.5, 0),
    (3, 0.00, 50, 0.00, 60, 0.00, 0, 1, 0.5, 0), (90, 0.95, 40, 0.90, 50, 1.00, 0, 0, 0.5, 0), (25, 0.40, 1, 0.00, 9, 0.00, 0, 0, 0.5, 0),
    (3, 0.00, 6, 0.00, 2, 1.00, 0, 0, 0, 0),
]


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    heading: bool
    article: bool
    other: float


class _Open(NamedTuple):
    """An open element, and what holds inside it."""
    tag: str
    heading: bool
    article: bool
    other: int
    silent: bool
    link: bool


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", False, False, 0, False, False)]
        self.opened: dict[str, int] = {}
        self.found: list[Block] = []
        self._text: list[str] = []
        self._linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            top, words = self.stack[-1], text.count(" ") + 1
            self.found.append(Block(text, words, min(1.0, self._linked / words), top.heading, top.article,
                                    min(1.0, top.other / SURE)))
        self._text, self._linked = [], 0

    def _pop_to(self, tag: str) -> None:
        while True:
            gone = self.stack.pop().tag
            self.opened[gone] -= 1
            if gone == tag:
                return

    def _implied_end(self, tag: str) -> None:
        """A paragraph ends where a block begins, a list item or cell where the next one does, a link at the next."""
        top = self.stack[-1].tag
        if tag in BLOCK_TAGS and self.opened.get("a") and top == "a":
            self._pop_to("a")
            top = self.stack[-1].tag
        if tag in BLOCK_TAGS and top == "p" or tag == top and tag in ("li", "dt", "dd", "td", "th", "tr", "a"):
            self._pop_to(top)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        if tag == "body":  # a head that was not closed ends here
            while len(self.stack) > 1:
                self.opened[self.stack.pop().tag] -= 1
        if tag in VOID_TAGS or not (tag in BLOCK_TAGS or tag in SILENT_TAGS or tag in ("a", "span")):
            return
        self._implied_end(tag)
        around = self.stack[-1]
        of = dict(attrs)
        article = around.article or tag in ("article", "main")
        named = tag not in ("html", "body", "article", "main")
        kept = around.other
        if tag == "main" and kept < HIDDEN or tag == "article" and kept == LOOSE:
            kept = 0
        sure = (tag in OTHER_TAGS or tag == "header" and not around.article or (of.get("role") or "").lower() in OTHER_ROLES)
        perhaps = tag == "form" or (of.get("role") or "").lower() == "form"
        other = max(kept, HIDDEN if "hidden" in of else SURE if sure else LOOSE if perhaps else 0,
                    _named(f"{of.get('class') or ''} {of.get('id') or ''}") if named else 0)
        if tag == "span":  # only one that is marked matters
            if other == around.other:
                return
            self._flush()
        self.stack.append(_Open(tag, around.heading or tag in HEADINGS, article, other,
                                around.silent or tag in SILENT_TAGS, around.link or tag == "a"))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag == "span" and self.stack[-1].tag == "span":
            self._flush()
        if self.opened.get(tag) and (tag != "span" or self.stack[-1].tag == "span"):
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.silent:
            self._text.append(data)
            if top.link:
                self._linked += len(data.split())

    def finish(self) -> list[Block]:
        self.close()
        self._flush()
        return self.found


def blocks(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    return parser.finish()


def features(found: list[Block]) -> np.ndarray:
    """The columns of the labelled table but the last."""
    near = np.zeros((len(found) + 2, 2))
    near[1:-1] = [(b.words, b.link_density) for b in found]
    flags = np.array([(b.heading, b.article, b.other) for b in found], float).reshape(-1, 3)
    return np.hstack([near[1:-1], near[:-2], near[2:], flags])


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A tree of (column, threshold, tree where at most it, tree where above) or a leaf's label, by Gini impurity."""
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for column in range(rows.shape[1]):
        values = np.unique(rows[:, column])
        for threshold in (values[:-1] + values[1:]) / 2:
            low = rows[:, column] <= threshold
            impurity = sum(side.sum() * labels[side].mean() * (1 - labels[side].mean()) for side in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(threshold), low)
    if best is None:
        return bool(share >= 0.5)
    _, column, threshold, low = best
    return (column, threshold, train_tree(rows[low], labels[low], depth - 1),
            train_tree(rows[~low], labels[~low], depth - 1))


def predict(tree, rows: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(rows), tree)
    column, threshold, low, high = tree
    out = np.empty(len(rows), bool)
    at_most = rows[:, column] <= threshold
    out[at_most], out[~at_most] = predict(low, rows[at_most]), predict(high, rows[~at_most])
    return out


def main_text(html: str, tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    return "\n".join(b.text for b, main in zip(found, predict(tree, features(found)), strict=True) if main)


def main_texts(pages: DataFrame, labelled: list[tuple] = LABELLED, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page, from its whole HTML."""
    table = np.array(labelled, float)
    tree = train_tree(table[:, :-1], table[:, -1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", tree) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.selectExpr(f"cast(`{id_col}` AS long) AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    return map_batches(rows, extract, "page_id long, url string, text string")
