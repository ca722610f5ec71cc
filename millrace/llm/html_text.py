"""Main text of web pages from parser events and the text-to-tag ratio of lines.

The standard library's parser is fed a page and sends events; every block
element begins a new line. A line's ratio is its characters outside links per
tag. The ratios of the whole page, boilerplate included, are smoothed by a
Gaussian, and the threshold is one standard deviation of the smoothed ratios.
Lines are clustered in regions, the runs below one container; a region is
content if its own ratio and its smoothed one both reach the threshold, and the
best region of a page always is. In a region of content, lines made of links go
where the smoothed ratio is below the threshold. What lies in an `article` is one
region and, like `main`, comes before all that lies elsewhere on the page, so on
such a page the threshold decides among the articles and the parts of `main`.

Some elements are no article by their meaning: menus, asides, footers, forms,
scripts and the like, and elements whose class, id or role is made of words that
mean such a thing. Their lines count as ratio 0. Class names and forms may also
wrap a whole page: if what they hold would leave no text, or an `article` or
`main` only inside them, they are not heeded there. An `article` is never judged
by its own class, unless it stands in another one.

Defined results: null, empty and text-free pages give an empty text; malformed
markup is read as browsers do, as far as it can be, and never fails; a long page
takes time and memory in proportion to its length; repeated pages are extracted
each; other columns of the input are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import steps

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is not part of a page at all.
SILENT = frozenset("head script style noscript template select textarea iframe object svg math canvas audio video datalist".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("nav footer aside button menu dialog".split())
#: Words that mean the same in a class, an id or a role,
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription sidebar aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer copyright share sharing social "
    "related recommended recommendations toolbar pagination pager login signup search contentinfo complementary".split()
)
#: reader comments among them,
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: and words that may stand beside them in a name, such as main-nav or comment-list.
NEUTRAL = frozenset("site page main top bottom left right wrapper wrap container box block list item items section area bar links link buttons button inner outer form post article entry thread".split())
#: Elements that their own kind closes, within these.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
LISTS = frozenset("table ul ol dl".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that bound a region of lines.
REGION = frozenset("article main section div td body html".split())
#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.5

# Why an element's text is not wanted: never, or unless it wraps the article.
SOFT, HARD = 1, 2


def judged(name: str) -> int:
    """What a class, id or role says: its words, split at - and _, must all be known, and one unwanted."""
    verdict = 0
    for item in name.lower().split():
        words = item.replace("_", "-").split("-")
        if all(w in UNWANTED or w in NEUTRAL or w in COMMENTS for w in words):
            if any(w in COMMENTS for w in words):
                return HARD
            if any(w in UNWANTED for w in words):
                verdict = SOFT
    return verdict


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    region: int
    main: bool
    heading: bool
    unwanted: int

    @property
    def links(self) -> bool:
        """More than half of it is in links."""
        return self.linked * 2 > len(self.text)

    @property
    def ratio(self) -> float:
        return 0.0 if self.unwanted else max(0, len(self.text) - self.linked) / max(1, self.tags)


class Lines(HTMLParser):
    """The lines of a page. The place of each kind of open element is known, so that
    end tags cost no search, however deep a page is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # tag, why it is not wanted, region before it
        self.where: dict[str, list[int]] = {}
        self.count = [0, 0, 0]  # open elements by SOFT and HARD
        self.silent = self.links = self.mains = self.articles = self.headings = 0
        self.region = self.regions = 0
        self.lines: list[Line] = []
        self._start()

    def _start(self) -> None:
        self.words, self.tags, self.linked = [], 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            why = HARD if self.count[HARD] else SOFT if self.count[SOFT] else 0
            self.lines.append(Line(text, self.tags, self.linked, self.region, self.mains > 0, self.headings > 0, why))
        self._start()

    def _why(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in DROPPED or tag == "header" and not self.mains:
            return HARD
        why = SOFT if tag == "form" else 0
        bare = tag in ("html", "body", "main") or tag == "article" and not self.articles
        for name, value in attrs:
            if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
                return HARD
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return HARD
            if not bare and value and name in ("class", "id", "role"):
                why = max(why, judged(value))
        return why

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, why, self.region = self.open.pop()
            self.where[tag].pop()
            self.count[why] -= 1
            self._enter(tag, -1)

    def _enter(self, tag: str, by: int) -> None:
        self.silent += by * (tag in SILENT)
        self.links += by * (tag == "a")
        self.mains += by * (tag in ("article", "main"))
        self.articles += by * (tag == "article")
        self.headings += by * (tag in HEADINGS)

    def _close(self, tags, within) -> None:
        at = self._last(tags)
        if at > self._last(within):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            if tag == "br":
                self.words.append(" ")
            else:
                self.flush()
            if tag in CLOSES_P:
                self._close(("p",), REGION)
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], LISTS)
        self.tags += 1
        if tag in VOID:
            return
        why = self._why(tag, attrs)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, why, self.region))
        self.count[why] += 1
        if tag in REGION and not self.articles:
            self.regions += 1
            self.region = self.regions
        self._enter(tag, 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.where.get(tag):
            self._pop(self.where[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)
            if self.links:
                self.linked += len(data)

    # The parser is fed a page at once, so what it would wait for does not come. Markup
    # that the page's end cuts off goes, as in browsers, and is looked at once only.

    def _rest(self, end: int) -> int:
        return len(self.rawdata) if end < 0 else end

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        # A quote that is never closed: the tag ends where it seems to.
        return self._rest(self.rawdata.find(">", i) + 1 or -1) if end < 0 else end

    def parse_endtag(self, i: int) -> int:
        return self._rest(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._rest(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._rest(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        # A marked section is a comment in HTML, whatever its keyword.
        if self.rawdata.startswith("<![", i):
            return self._rest(self.parse_bogus_comment(i))
        return self._rest(super().parse_html_declaration(i))


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside the page count."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    whole = np.convolve(values, kernel)[radius : radius + len(values)]
    return whole / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def lines_of(html: str) -> list[Line]:
    """All lines of a page, with what holds the article no longer marked as unwanted."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    wanted = [x for x in lines if not x.unwanted]
    if not any(x.main for x in wanted) and any(x.main and x.unwanted == SOFT for x in lines):
        for x in lines:
            x.unwanted = 0 if x.main and x.unwanted == SOFT else x.unwanted
    elif not wanted:
        for x in lines:
            x.unwanted = 0 if x.unwanted == SOFT else x.unwanted
    return lines


def content(lines: list[Line]) -> list[Line]:
    """The lines of the regions that smoothing and the threshold take for content."""
    if not lines:
        return []
    ratios = smooth(np.array([x.ratio for x in lines]))
    held = [(x, float(r)) for x, r in zip(lines, ratios) if not x.unwanted]
    if any(x.main for x, _ in held):
        held = [(x, r) for x, r in held if x.main]
    if not held:
        return []
    smoothed: dict[int, float] = {}
    own: dict[int, float] = {}
    for x, r in held:
        smoothed[x.region] = max(smoothed.get(x.region, 0.0), r)
        # A heading is short by nature: the text around it decides.
        own[x.region] = max(own.get(x.region, 0.0), r if x.heading else x.ratio)
    threshold = min(float(ratios.std()), max(min(smoothed[k], own[k]) for k in own))
    chosen = {k for k in own if smoothed[k] >= threshold and own[k] >= threshold}
    return [x for x, r in held if x.region in chosen and (x.main or not x.links or r >= threshold)]


def main_text(html: str | None) -> str:
    """The article of one page, its blocks joined by one blank."""
    return " ".join(x.text for x in content(lines_of(html))) if html else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_key", "address", "found", "n_chars"]
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    out = pages.select(F.col(key).alias("page_key"), F.col(url).alias("address"), F.col(html).cast("string").alias("html")).mapInArrow(
        texts, f"page_key {kinds[0]}, address {kinds[1]}, found string, n_chars long"
    )
    return out.select(F.col("page_key").alias(key), F.col("address").alias(url), F.col("found").alias("text"), "n_chars")
