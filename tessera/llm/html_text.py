"""Main text of web pages by text-to-tag ratios.

The standard library's parser gives events; nothing is kept of the page but its *lines*: the text between two
block boundaries, the number of tags in it, and the containers around it. What elements and roles name as page furniture
(navigation, page headers, footers, sidebars, forms, scripts ...) takes no part. The text-to-tag ratios of all other lines are smoothed with a Gaussian
and split into two clusters at the threshold between their means; the upper one is the content, and it chooses the region:

* a container whose class or id names furniture (advert, notice, reader comments ...) is left out, unless it holds over half of the content cluster, in
  several blocks, and every ``article`` or ``main`` there is;
* ``article`` elements, or else ``main``, are the region if they hold at least half of the content cluster that is left, else the whole page is;
* the region is narrowed to the deepest container that holds all headings and list items and every line whose own ratio is at the threshold or at
  ``PROSE``, whichever is less: only lines that are nearly all tags can stay outside.

All lines of the region are the text, short ones too: blocks in page order, white space collapsed, joined by a line feed.

Defined results: null or empty html, and a page without content, give the empty text; unclosed and stray tags are closed as browsers
do for blocks; character references are decoded; rows with null ids or that repeat are each extracted; an empty table gives an empty
table; ``extract`` replaces columns named like its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article main section div td body center table tbody tr ul ol dl blockquote html".split())
OUTLINE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd".split())
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu audio video title".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay comment comments commentlist respond replies disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login widget toolbar skip".split()
)
PAGE_HEADER_WORDS = frozenset("header masthead topbar".split())
# Parts of a class name that say which part of a thing it is, and first parts that say what a page has or lacks.
PART_WORDS = frozenset("area bar block body box button buttons col column container content desktop fixed form group icon icons inner item items left link links list main mobile outer panel post posts articles stories right row section slot sticky text title top bottom unit wrap wrapper".split())
STATE_WORDS = frozenset("no not non has with without is hide show".split())
# Which open elements a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Characters a tag from which a line is text, whatever the threshold.
PROSE = 5
WORD = re.compile(r"[a-z]+")


def names_furniture(value: str, inside: bool) -> bool:
    """Whether a class or id has a name of furniture: its last word, but for words of ``PART_WORDS``; page headers are furniture outside of landmarks only."""
    for token in value.lower().split():
        words = WORD.findall(token)
        if not words or words[0] in STATE_WORDS:
            continue
        while words and words[-1] in PART_WORDS:
            words.pop()
        if words and (words[-1] in FURNITURE_WORDS or not inside and words[-1] in PAGE_HEADER_WORDS):
            return True
    return False


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]  # numbers of the containers around it
    landmark: str  # the outermost one
    outline: bool  # in a heading or list
    named: tuple[int, ...]  # numbers of the elements around it that a class or id names as furniture


class Lines(HTMLParser):
    """Gathers the lines that no element or role marks as furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool]] = []  # element, furniture, named as furniture
        self.path: list[int] = []
        self.landmarks: list[str] = []
        self.named: list[int] = []
        self.furniture = 0
        self.made = 0
        self.tags = 0
        self.text: list[str] = []

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append(Line(line, self.tags, tuple(self.path), self.landmarks[0] if self.landmarks else "", any(x[0] in OUTLINE for x in self.open), tuple(self.named)))
        self.text, self.tags = [], 0

    def is_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE or tag == "header" and not self.landmarks:
            return True
        if tag in ("body", "html", "article", "main"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in FURNITURE_ROLES for name, value in attrs)

    def is_named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("body", "html", "article", "main") and any(name in ("class", "id") and value and names_furniture(value, bool(self.landmarks)) for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            if tag in CLOSES:
                self.close_open(CLOSES[tag], LIMITS[tag])
            self.close_open({"p"}, CONTAINER | {"li", "dd", "th", "form", "aside", "nav", "header", "footer", "button"})
        elif tag == "br":
            self.text.append(" ")
        if not self.furniture:
            self.tags += 1
        if tag in VOID:
            return
        furniture, named = self.is_furniture(tag, attrs), self.is_named(tag, attrs)
        if (furniture or named) and not self.furniture:
            self.end_line()
        self.open.append((tag, furniture, named))
        self.furniture += furniture
        self.made += 1
        if named:
            self.named.append(self.made)
        if tag in CONTAINER:
            self.path.append(self.made)
        if tag in ("article", "main"):
            self.landmarks.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no empty elements but the void ones

    def pop(self) -> None:
        tag, furniture, named = self.open.pop()
        if tag in BLOCK or furniture or named:
            self.end_line()
        self.furniture -= furniture
        if named:
            self.named.pop()
        if tag in CONTAINER:
            self.path.pop()
        if tag in ("article", "main"):
            self.landmarks.pop()

    def close_open(self, tags: set[str], limits: set[str] | frozenset[str]) -> None:
        """Closes the innermost open one of ``tags``, if no element of ``limits`` is inside it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in limits:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        if not self.furniture:
            self.tags += 1
        if any(x[0] == tag for x in self.open):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.furniture:
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolution with a Gaussian; weights beyond the ends are left out."""
    r = max(1, int(2 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]


def content_cluster(values: np.ndarray) -> tuple[np.ndarray, float]:
    """Which values are in the upper of two clusters, and the threshold, which moves to the middle of the clusters' means until it stays."""
    cut = float(values.mean())
    for _ in range(50):
        high = values >= cut
        if high.all():
            return high, cut
        new = (values[high].mean() + values[~high].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return values >= cut, cut


def content(lines: list[Line]) -> tuple[np.ndarray, float]:
    """Which lines are in the content cluster, and its threshold."""
    return content_cluster(smooth(ratios(lines)))


def ratios(lines: list[Line]) -> np.ndarray:
    return np.array([len(x.text) for x in lines], float) / np.maximum(1, [x.tags for x in lines])


def main_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    (high, cut), size = content(lines), np.array([len(x.text) for x in lines])
    held: dict[int, list[int]] = {}  # content, its lines, and lines of landmarks in each element named as furniture
    for x, n, ok in zip(lines, size.tolist(), high.tolist(), strict=True):
        for e in x.named:
            of = held.setdefault(e, [0, 0, 0])
            of[0] += n * ok
            of[1] += ok
            of[2] += x.landmark != ""
    marked, all_content = sum(x.landmark != "" for x in lines), size[high].sum()
    spared = {e for e, (n, blocks, marks) in held.items() if 2 * n > all_content and blocks > 1 and marks == marked}
    kept = np.array([spared.issuperset(x.named) for x in lines])
    if not kept.any():
        return ""
    lines, high, size = [x for x, y in zip(lines, kept, strict=True) if y], high[kept], size[kept]
    whole = size[high].sum()
    for mark in ("article", "main"):
        inside = np.array([x.landmark == mark or mark == "main" and x.landmark != "" for x in lines])
        if inside.any() and 2 * size[high & inside].sum() >= whole:
            break
    else:
        inside = np.ones(len(lines), bool)
    text = (ratios(lines) >= min(PROSE, cut)) | np.array([x.outline for x in lines])
    level = 0
    while True:  # go down while one container holds all that is text
        best = {lines[k].path[level] if len(lines[k].path) > level else None for k in np.flatnonzero(inside & text)}
        if len(best) != 1 or None in best:
            break
        best = best.pop()
        inside &= np.array([len(x.path) > level and x.path[level] == best for x in lines])
        level += 1
    return "\n".join(x.text for x, y in zip(lines, inside, strict=True) if y)


def _extract(batches: Iterator[pa.RecordBatch], at: int, names: list[str], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            text = [main_text(h.as_py()) for h in batch.column(at)]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=names)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars`` (code points); a map without a shuffle."""
    pages = pages.drop(*({"text", "n_chars"} - {html_col}))
    at = pages.columns.index(html_col)
    fields = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(lambda it: _extract(it, at, schema.names), schema)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return extract(pages.select(F.col("page_id"), F.col("url"), F.col("html"))).select("page_id", "url", "text", "n_chars")
