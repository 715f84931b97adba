"""Main text of HTML pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The events of the standard library's streaming parser are turned into lines, one for each block of
text.  A line's ratio is its characters by its tags, of which links count LINK_TAGS more; what its
elements say (menu, footer, advert ... by name, role or class) is evidence that divides the ratio, no
verdict.  The ratios are smoothed with a Gaussian, and a threshold, a share of the smoothed ratios'
deviation, parts content from the rest.

Chosen lines cluster into regions.  The region of a page is the deepest container that holds nearly all
that was chosen, weighted by smoothed ratio and length, so that a few lines elsewhere do not widen it; it
grows to the container round it while what that adds is as dense as content, and takes the main heading
above it.  Of the region all lines are kept, short ones too, but for those in elements whose evidence is
against them.  Weak evidence (a form, a header, a class name) counts only where the element holds little
of what was chosen, so that a wrapper round the whole text loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import sliced, small_batches

#: Width of the Gaussian in lines, and its reach.
SIGMA, REACH = 1.0, 2
#: A line is chosen if its smoothed ratio is so many deviations of all smoothed ratios.
THRESHOLD = 0.5
#: Tags that a link counts more, and by what evidence divides a ratio.
LINK_TAGS, AGAINST = 4, 20.0
#: Share of the chosen weight that the region holds, and that makes an element content in spite of weak evidence.
REGION, HOLDS = 0.9, 0.6

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that show no text of the page.
_UNSEEN = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map select option textarea".split())
#: Elements whose name is evidence against them, strong and weak.
_NEVER, _ASIDE = frozenset("nav footer aside button menu dialog".split()), frozenset("header form fieldset".split())
#: Elements that are part of a text and no container of one.
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd pre blockquote table tbody thead tfoot tr caption figure figcaption address details summary legend".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NEVER_ROLES, _ASIDE_ROLES = frozenset("navigation contentinfo complementary alertdialog dialog menu menubar toolbar".split()), frozenset("banner search form alert".split())
#: Words of class names and ids that are evidence against an element.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar sidebar aside widget related recommended recommendations share sharing social comment comments "
    "disqus respond replies reply notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "form search pagination pager skip".split()
)
#: What readers and advertisers write is not the article even where it is most of a page's text.
_OTHERS_WORDS = frozenset("ad ads advert adverts advertisement sponsored comment comments disqus replies".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = re.compile(r"[a-z]+")
#: Kinds of evidence.
FOR, WEAK, STRONG, UNSEEN = range(4)


def evidence(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """What an element's name, role, class and id say; a header in an article is its heading."""
    if tag in _UNSEEN:
        return UNSEEN
    found = STRONG if tag in _NEVER else WEAK if tag in _ASIDE and not (tag == "header" and in_article) else FOR
    for name, value in attrs:
        if tag not in ("html", "body") and (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or "")):
            return UNSEEN
        if name == "role":
            role = (value or "").lower()
            found = max(found, STRONG if role in _NEVER_ROLES else WEAK if role in _ASIDE_ROLES else FOR)
        if name in ("class", "id") and tag not in _HEADINGS:
            for x in (value or "").split():
                words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower())
                if words and words[0] not in ("has", "with", "no"):
                    if _OTHERS_WORDS.intersection(words) and tag not in ("html", "body", "main"):
                        found = max(found, STRONG)
                    elif _ASIDE_WORDS.intersection(words) and tag not in ("html", "body", "main", "article"):
                        found = max(found, WEAK)
    return found


class _Lines(HTMLParser):
    """Lines of a page (text, tags, element), and the elements that hold them (parent, evidence, name)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag and number of the element
        self.count: dict[str, int] = {}  # how many of each tag are open
        self.parent, self.kind, self.name = [-1], [FOR], ["html"]  # element 0 is the page
        self.lines: list[tuple[str, float, int]] = []
        self.text: list[str] = []
        self.tags = 0.0

    @property
    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text and self.kind[self.here] != UNSEEN:
                self.lines.append((text, self.tags, self.here))
                self.tags = 0
            self.text = []

    def close_to(self, place: int) -> None:
        self.cut()
        self.drop(place)

    def drop(self, place: int) -> None:
        for tag, _ in self.open[place:]:
            self.count[tag] -= 1
        del self.open[place:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        above = self.kind[self.here]
        own = evidence(tag, attrs, bool(self.count.get("article")))
        if tag in _BLOCK:
            self.cut()
            if tag != "br":
                self._imply(tag)
                above = self.kind[self.here]
        elif self.text and own != FOR:
            self.cut()  # what stands before an element of another kind is a line of its own
        self.tags += 1 + LINK_TAGS * (tag == "a")
        if tag in _VOID:
            return
        if tag in _BLOCK or own != FOR:
            self.parent.append(self.here)
            self.kind.append(UNSEEN if above == UNSEEN else own)
            self.name.append(tag)
            number = len(self.parent) - 1
        else:
            number = self.here  # an inline element belongs to its block
        self.open.append((tag, number))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _imply(self, tag: str) -> None:
        """Close the paragraph, or the list item, cell or row, that a start tag ends."""
        ends = _CLOSED_BY.get(tag, set()) | {"p"}
        if not any(self.count.get(x) for x in ends):
            return
        for place in range(len(self.open) - 1, -1, -1):
            name = self.open[place][0]
            if name in ends:
                self.close_to(place)
                if name == "p":
                    continue
                return
            if name in _BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "math", "path"):
            self.drop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.cut()
        if not self.count.get(tag):
            return  # nothing to close
        for place in range(len(self.open) - 1, -1, -1):
            name, number = self.open[place]
            if name == tag:
                if tag in _BLOCK or self.kind[number] != FOR:
                    self.close_to(place)
                else:
                    self.drop(place)
                return
            if name in _BLOCK and tag not in _BLOCK:
                return  # an inline element's end reaches no further than its block

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):  # a bogus comment in HTML
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)


class Page:
    """Lines of a page and its elements; elements are numbered in page order, so that a parent comes before its children."""

    def __init__(self, html: str):
        p = _Lines()
        p.feed(html)
        p.close()
        p.cut()
        self.texts = [t for t, _, _ in p.lines]
        self.length = np.array([len(t) for t in self.texts], np.float64)
        self.tags = np.array([n for _, n, _ in p.lines], np.float64)
        self.at = np.array([e for _, _, e in p.lines], np.int64)
        self.parent, self.kind, self.name = p.parent, p.kind, p.name
        worst = list(p.kind)  # evidence of an element or what it stands in
        for e in range(1, len(worst)):
            worst[e] = max(worst[e], worst[p.parent[e]])
        self.worst = np.array(worst)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Weight of the lines in each element."""
        out = np.bincount(self.at, weight, len(self.parent))
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends, over the lines that are there."""
    n = len(ratio)
    weight = np.convolve(np.ones(n), _KERNEL)[REACH : REACH + n]
    return np.convolve(ratio, _KERNEL)[REACH : REACH + n] / weight


def ratios(page: Page) -> np.ndarray:
    """Characters by tags of each line, divided where its elements are evidence against it."""
    ratio = page.length / np.maximum(1, page.tags)
    return np.where(page.worst[page.at] == FOR, ratio, ratio / AGAINST)


def chosen_lines(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, smoothed ratio) of the lines."""
    ratio = smoothed(ratios(page))
    return ratio >= THRESHOLD * ratio.std(), ratio


def inside(page: Page, region: int, held: np.ndarray) -> np.ndarray:
    """Lines of a region but for those in elements of it that are no content."""
    total = held[0]
    take = [False] * len(held)
    take[region] = page.kind[region] != STRONG
    for e in range(region + 1, len(held)):
        take[e] = take[page.parent[e]] and (page.kind[e] == FOR or page.kind[e] == WEAK and held[e] >= HOLDS * total)
    return np.array(take)[page.at]


def kept_lines(page: Page) -> np.ndarray:
    """The lines of the region that the chosen lines make."""
    chosen, ratio = chosen_lines(page)
    weight = np.where(chosen, ratio * page.length, 0.0)
    if not weight.any():
        weight = page.length
    held = page.sums(weight)
    at = region = 0
    for e in range(1, len(held)):  # children come after their parent
        if page.parent[e] == at and held[e] >= REGION * held[0]:
            at = e
            if page.name[e] not in _PARTS:
                region = e
    take = inside(page, region, held)
    dense = THRESHOLD * ratio.std()
    while region:
        up = page.parent[region]
        while up and page.name[up] in _PARTS:
            up = page.parent[up]
        wider = inside(page, up, held)
        more = wider & ~take
        if more.any():
            if page.length[more].sum() / max(1.0, page.tags[more].sum()) < dense:
                first = np.flatnonzero(take)[:1]
                heading = [k for k in np.flatnonzero(more).tolist() if page.name[page.at[k]] == "h1" and (not len(first) or k < first[0])]
                take[heading[-1:]] = True
                break
            take = wider | take
        region = up
    return take


def main_text(html: str | None) -> str:
    """The main text, blocks joined by one space; empty for null, empty and contentless pages.

    White space is what Python takes for it, no-break spaces too.
    """
    page = Page(html or "")
    if not page.texts:
        return ""
    return " ".join(t for t, x in zip(page.texts, kept_lines(page).tolist(), strict=True) if x)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row.

    Null, empty and contentless pages have an empty text and 0.  Ids and urls are kept as they are, nulls
    and repeated rows too.  Pages are independent, so that ties can't arise.  An empty table gives no
    rows; other columns are not read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
