"""Main text of web pages (operator 3).

The standard library's streaming parser turns a page into lines: a line is the
text between two block boundaries, with the number of tags seen in it and the
number of its characters that are link text.  Elements that never are content
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles: by tag, role, or a name in the class or id) give no lines.  A class or id
name counts if one of its parts is such a word, unless it begins with no-, has-,
with- or the like.  An element skipped by its class or id is not skipped if it
contains an article or main element and the page has none outside of what is
skipped, nor if it holds blocks within blocks and the page has no text elsewhere.

Lines inside an article or main element are the main text if there are any.
On other pages each line's text-to-tag ratio (link text does not count as text)
is smoothed with a Gaussian over its neighbours, which lifts short paragraphs
inside an article and flattens a stray long line outside.  A threshold parts
the logarithms of the smoothed ratios into two clusters, where the variance
between them is greatest; lines of the upper one that have text of their own
are sure.  The content region is the smallest element that holds four fifths of
the sure text.  Of its direct parts those with a sure line are kept, all between
the first and last of these, and before and after them headings and parts of
the same kind; parts that are mostly links are not.

Character references are decoded; white space inside a line becomes one space;
lines are joined by one line feed.  Nothing is cut off.

Defined cases: null and empty html and pages without text give an empty string;
unclosed p, li, dt, dd, option and table parts end where a start tag implies it,
other unclosed elements where the parser's open parent ends; null ids and
repeated rows are kept as they are; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of HTML elements, roles and customary class words
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("head title script style noscript template nav header footer aside form button select textarea iframe svg "
              "canvas object dialog menu audio video map".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search "
             "section summary table tbody td tfoot th thead tr ul".split())
WHOLE = {"article", "main"}
SKIPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SKIPPED_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                    "consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter "
                    "notice notices notification pagination popup promo promoted related respond share sharing sidebar "
                    "signup social sponsor sponsored subscribe toolbar widget".split())
#: "no-sidebar" or "has-comments" tell of the layout, not of the element
LAYOUT_PARTS = set("no not non has have with without is show hide".split())
PART = re.compile(r"[-_:]+")
#: start tags that end an open p, and the elements beyond which they do not
ENDS_P = BLOCKS - set("body caption center head html legend optgroup option tbody td tfoot th thead tr".split())
P_SCOPE = set("button caption html object select svg table td template th".split())
LIST_SCOPE = BLOCKS - set("address div p li dd dt".split()) | {"button", "object", "select", "template"}
#: start tag: (open elements that it ends, elements beyond which it ends none)
IMPLIED_ENDS = {
    "li": ({"li"}, LIST_SCOPE), "dd": ({"dd", "dt"}, LIST_SCOPE), "dt": ({"dd", "dt"}, LIST_SCOPE),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"tr", "thead", "tbody", "tfoot"}, {"table"})),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Gaussian kernel over lines: standard deviation and reach
SIGMA, REACH = 1.0, 2
#: share of the sure text that the content region holds
REGION_SHARE = 0.8


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    #: number of the nearest block element; whether an article or main is around it
    block: int
    whole: bool

    def solid(self) -> int:
        return len(self.text.replace(" ", ""))


def names_skipped(names: str) -> bool:
    """Whether one of the names of a class or id attribute stands for something that is no content."""
    for name in names.split():
        parts = [x for x in PART.split(name) if x]
        if parts and parts[0] not in LAYOUT_PARTS and not SKIPPED_WORDS.isdisjoint(parts):
            return True
    return False


def skipped(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in SKIPPED:
        return True
    if tag in WHOLE or tag in ("html", "body"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in SKIPPED_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def skipped_by_name(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in WHOLE or tag in ("html", "body"):
        return False
    return any(name in ("class", "id") and names_skipped((value or "").lower()) for name, value in attrs)


class Lines(HTMLParser):
    """Collects the lines of one page from parser events."""

    def __init__(self, kept: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        #: numbers of the start tags that are not skipped by their class or id
        self.kept = kept
        self.starts = 0
        #: (number of the start tag, depth) of the element that is skipped by its class or id
        self.by_name: tuple[int, int] | None = None
        #: those that contain an article or main; whether one stands outside of what is skipped
        self.wrappers: set[int] = set()
        #: those that hold blocks within blocks
        self.nested: set[int] = set()
        self.whole_seen = False
        self.lines: list[Line] = []
        #: open elements: (tag, inside something skipped, number of the nearest block, inside an article or main)
        self.open: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
        #: places of the open elements by tag, and of those where something skipped begins
        self.places: dict[str, list[int]] = defaultdict(list)
        self.skips: list[int] = []
        #: parent and tag of each block
        self.parents, self.names = [0], [""]
        self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, *self.open[-1][2:]))
        self.parts, self.tags, self.linked = [], 0, 0

    def close_implied(self, ends: set[str], scope: set[str]) -> None:
        """Close the open elements that a start tag ends; none that something skipped, begun since, lies in."""
        if not any(self.places[t] for t in ends):
            return
        limit = max((self.places[t][-1] for t in scope if self.places[t]), default=0)
        if self.skips and self.open[self.skips[-1]][0] not in ends:
            limit = max(limit, self.skips[-1])
        at = min((p for t in ends for p in itertools.takewhile(lambda p: p > limit, reversed(self.places[t]))), default=None)
        if at is not None:
            if not self.open[at - 1][1]:
                self.end_line()
            while len(self.open) > at:
                self.pop()

    def pop(self) -> str:
        name = self.open.pop()[0]
        self.places[name].pop()
        if self.skips and self.skips[-1] == len(self.open):
            self.skips.pop()
        self.links -= name == "a"
        if self.by_name and len(self.open) <= self.by_name[1]:
            self.by_name = None
        return name

    def handle_starttag(self, tag, attrs) -> None:
        self.starts += 1
        if tag in IMPLIED_ENDS:
            self.close_implied(*IMPLIED_ENDS[tag])
        if tag in ENDS_P:
            self.close_implied({"p"}, P_SCOPE)
        _, skip, block, whole = self.open[-1]
        if tag in BLOCKS and not skip:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in WHOLE:
            if not skip:
                self.whole_seen = True
            elif self.by_name:
                self.wrappers.add(self.by_name[0])
        if tag in BLOCKS and self.by_name and any(x[0] in BLOCKS for x in self.open[self.by_name[1] + 1:self.by_name[1] + 3]):
            self.nested.add(self.by_name[0])
        by_name = not skip and not skipped(tag, attrs) and self.starts not in self.kept and skipped_by_name(tag, attrs)
        if by_name:
            self.by_name = (self.starts, len(self.open))
        if not skip and (by_name or skipped(tag, attrs)):
            skip = True
            self.skips.append(len(self.open))
            if tag in BLOCKS:
                self.end_line()
        if tag in BLOCKS and not skip:
            self.parents.append(block)
            self.names.append(tag)
            block = len(self.names) - 1
        self.links += tag == "a"
        self.places[tag].append(len(self.open))
        self.open.append((tag, skip, block, whole or (tag in WHOLE and not skip)))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if not self.places[tag]:
            if tag == "p":
                self.end_line()
            return
        self.tags += 1
        if tag in BLOCKS and not self.open[-1][1]:
            self.end_line()
        while True:
            if self.pop() == tag:
                break

    def handle_data(self, data) -> None:
        if not self.open[-1][1]:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def parsed(html: str) -> Lines:
    kept: frozenset[int] = frozenset()
    while True:
        parser = Lines(kept)
        parser.feed(html)
        parser.close()
        parser.end_line()
        around = parser.wrappers if not parser.whole_seen else set()
        if not around and not parser.lines:
            around = parser.nested
        if not around:
            return parser
        kept |= around


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is normalised over what exists."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[REACH:REACH + len(ratios)]
    return np.convolve(ratios, kernel)[REACH:REACH + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters: the cut with the greatest variance between them."""
    x = np.sort(values)
    n, total = np.arange(1, len(x)), np.cumsum(x)
    if not len(n) or x[0] == x[-1]:
        return x[0]
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(x) - n)
    between = np.where(x[1:] > x[:-1], n * (len(x) - n) * (high - low) ** 2, -1.0)
    return x[1:][between.argmax()]


def region_lines(lines: list[Line], parents: list[int], names: list[str]) -> list[int]:
    """The lines of the content region, by clustering of smoothed text-to-tag ratios."""
    own = np.array([max(x.solid() - x.linked, 0) for x in lines])
    ratios = own / np.array([max(x.tags, 1) for x in lines])
    logs = np.log1p(smoothed(ratios))
    sure = (logs >= threshold(logs)) & (own > 0)
    if not sure.any():
        sure = own == own.max()
    # text of sure lines in each block and all below; numbers of blocks rise from parents to children
    mass = np.zeros(len(names))
    for x, y, m in zip(lines, sure, own):
        mass[x.block] += m if y else 0
    for i in range(len(names) - 1, 0, -1):
        mass[parents[i]] += mass[i]
    region = int(np.flatnonzero(mass >= REGION_SHARE * mass[0])[-1]) if mass[0] else 0
    # the direct part of the region that each block lies in: -1 outside, the region itself for text between its parts
    part = [-1] * len(names)
    for i in range(len(names)):
        part[i] = region if i == region else i if i and parents[i] == region else part[parents[i]] if i else -1
    inside = [i for i, x in enumerate(lines) if part[x.block] >= 0]
    keys = {i: part[lines[i].block] if part[lines[i].block] != region else -2 - i for i in inside}  # a line between parts is a part
    order = list(dict.fromkeys(keys[i] for i in inside))
    solid, linked, certain = Counter(), Counter(), set()
    for i in inside:
        solid[keys[i]] += lines[i].solid()
        linked[keys[i]] += min(lines[i].linked, lines[i].solid())
        if sure[i]:
            certain.add(keys[i])
    kind = {k: names[k] if k >= 0 else "" for k in order}
    kinds = {kind[k] for k in certain} | HEADINGS
    at = [n for n, k in enumerate(order) if k in certain]
    first, last = at[0], at[-1]
    fits = lambda k: kind[k] in kinds and 2 * linked[k] <= solid[k]
    while first > 0 and fits(order[first - 1]):
        first -= 1
    while last + 1 < len(order) and fits(order[last + 1]):
        last += 1
    chosen = {k for k in order[first:last + 1] if k in certain or 2 * linked[k] <= solid[k]}
    return [i for i in inside if keys[i] in chosen]


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    if not page.lines:
        return ""
    whole = [x.text for x in page.lines if x.whole]
    return "\n".join(whole or [page.lines[i].text for i in region_lines(page.lines, page.parents, page.names)])


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) for every row of ``pages``."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in column], dtype=object)

    found = pages.select(*keep, texts(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
