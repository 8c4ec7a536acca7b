"""Main text of HTML pages by text-to-tag ratio.

A streaming parser turns a page into lines, one per block, and counts the tags of
each.  A line's value is its text length per tag.  The values are smoothed with a
Gaussian along runs of equally marked lines, two-means clustering finds the threshold,
and the regions whose mean value (weighted by text) reaches it are the content.  So a
short line, a list or a paragraph of links stays with the container that it is in.

A region is a container's own lines: a ``div``, ``section`` or table cell, a list or
table that is mostly links, and an ``article`` or ``main`` (also by role, or by a class
such as ``article-body``) with all that is in it but further articles.  A ``main`` with
one article is one region with it.

Marks steer the regions.  Lines inside menus, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are never content: such elements, and
elements with a class or role of which a whole token consists of such words
(``cookie-notice``, ``ad-slot``, not ``related-work`` or ``has-sidebar``).  A form or a
classed element does not close an article that lies inside it; hidden elements and
reader comments do.  Where nothing else is left on a page, forms and classes count for
nothing.  Where a page marks an article, lines outside of it have a quarter of their
value, and the marked region with most text is always content; other marked regions
(teasers) are, if their value reaches the threshold.  Silent elements inside a line
(script, svg, button, …) leave a gap, not a line end.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one line feed.  Null and empty html give an empty
text.  Unclosed and stray tags are tolerated: an end tag closes what it can reach.
The time is linear in the page, however deep its elements lie.  Repeated rows are
extracted one by one, empty tables give an empty result, other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import slices

SIGMA = 1.0
RADIUS = 3

#: Elements whose text is never shown or never part of an article.
SILENT = frozenset("head title script style template noscript iframe object svg math canvas audio video select "
                   "option datalist textarea button input label form nav footer aside menu dialog".split())
#: Elements that end the line before them and start a new one.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search "
                   "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open paragraph can't contain.
_ENDS_P = BLOCKS - {"li", "td", "th", "tr", "dd", "dt", "body", "html"}
MAIN = frozenset(("article", "main"))
#: Silent elements that do not close an article inside them.
_SOFT = frozenset(("form", "label", "fieldset"))
#: Words of class and role tokens that mark boilerplate, and words that add nothing.
_BOILERPLATE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo sidebar aside "
                         "complementary ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
                         "promotion cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup "
                         "modal comment comments disqus reply replies respond related recommended share sharing social "
                         "pagination pager search form masthead topbar toolbar widget".split())
_PLAIN = frozenset("list box bar block wrapper container slot unit buttons links area panel articles posts stories items".split())
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_COMMENT_IDS = frozenset("comments disqus disqus_thread respond".split())
#: Words of class tokens that mark the article, together with ``article``.
_ARTICLE = frozenset("article body content text main full entry post page".split())
#: Elements that marks can take out inside a marked article.
_CONTAINERS = frozenset("div section ul ol dl table header figure fieldset details center".split())
#: Elements with a region of their own, and those that have one if they are mostly links.
_HOLDERS = frozenset("div section td th center fieldset details blockquote".split())
_LISTS = frozenset("ul ol dl menu table".split())
_TOKEN = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Marks of lines: shut (no article inside counts), out, undecided, in a marked article.
SHUT, OUT, PLAIN, IN = -2, -1, 0, 1
#: Share of their value that lines outside of a marked article keep.
OUTSIDE = 0.25


def _tokens(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
    return [{t.lower() for t in _TOKEN.findall(token)} for name, value in attrs if value and name in ("class", "role")
            for token in value.split()]


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true"
               or name == "style" and value and "display:none" in value.replace(" ", "").lower() for name, value in attrs)


def _furniture(attrs: list[tuple[str, str | None]]) -> int | None:
    """OUT or SHUT if a whole class or role token consists of boilerplate words."""
    out = None
    for words in _tokens(attrs):
        if words & _BOILERPLATE and words <= _BOILERPLATE | _PLAIN:
            if words & _COMMENTS:
                return SHUT
            out = OUT
    if any(name == "id" and value and value.strip().lower() in _COMMENT_IDS for name, value in attrs):
        return SHUT
    return out


class Lines(HTMLParser):
    """Collects (text, tags, mark, region) per block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        #: Open elements: tag, and what held outside of them (mark, gap mark, region).
        self.open: list[tuple[str, int, int | None, int]] = []
        #: Places of the open elements of each tag.
        self.places: dict[str, list[int]] = {}
        #: Regions: parent, kind (article, main, list, holder), text, linked text.
        self.regions: list[list] = [[-1, "", 0, 0]]
        self.region = 0
        self.mark = PLAIN
        #: Inside a silent element of a line: that line's mark.
        self.around: int | None = None
        self.gap = False
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self._line_mark(), self.region))
            self.regions[self.region][2] += len(text)
            self.regions[self.region][3] += min(self.linked, len(text))
            self.tags = 0
        self.parts.clear()
        self.linked = 0
        self.gap = False

    def _line_mark(self) -> int:
        return self.mark if self.around is None else self.around

    def _enter(self, tag: str, mark: int, region: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.mark, self.around, self.region))
        if mark != self.mark and tag not in BLOCKS and self.around is None:
            self.around = self.mark
            self.gap = True
        self.mark, self.region = mark, region

    def _leave(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all inside it, if there is one."""
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        _, self.mark, self.around, self.region = self.open[at]
        for name, *_ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]

    def _child_mark(self, tag: str, attrs: list[tuple[str, str | None]], main: bool) -> int:
        if self.mark == SHUT or attrs and _hidden(attrs):
            return SHUT
        if tag in SILENT:
            return OUT if tag in _SOFT and self.mark != SHUT else SHUT
        found = _furniture(attrs) if attrs and tag not in ("html", "body") else None
        if found == SHUT and (self.mark != IN or tag in _CONTAINERS):
            return SHUT
        if main:
            return IN
        if self.mark == OUT:
            return OUT
        if tag == "header" and self.mark == PLAIN:
            return SHUT
        if found is not None and (self.mark != IN or tag in _CONTAINERS):
            return found
        return self.mark

    def _child_region(self, tag: str, mark: int, main: bool) -> int:
        kind = ("main" if tag == "main" else "article") if main and mark == IN else \
            "" if mark == IN else "list" if tag in _LISTS else "holder" if tag in _HOLDERS else ""
        if not kind:
            return self.region
        self.regions.append([self.region, kind, 0, 0])
        return len(self.regions) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._cut()
            if tag in _ENDS_P:
                self._leave("p")
        main = tag in MAIN or bool(attrs) and tag in ("div", "section") and self.mark != IN and any(
            words == {"main"} and name == "role" or name == "class" and "article" in words and words <= _ARTICLE
            for name, value in attrs if value and name in ("class", "role")
            for words in ({t.lower() for t in _TOKEN.findall(token)} for token in value.split()))
        mark = self._child_mark(tag, attrs, main)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "li":
            item = self.places.get("li")
            if item and item[-1] > max((self.places[h][-1] for h in ("ul", "ol", "menu") if self.places.get(h)), default=-1):
                self._leave("li")
                mark = self._child_mark(tag, attrs, main)
        self._enter(tag, mark, self._child_region(tag, mark, main))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self._leave(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._cut()
        self.tags += 1
        if self.places.get(tag):
            _, mark, around, _ = self.open[self.places[tag][-1]]
            if (mark if around is None else around) != self._line_mark():
                self._cut()
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        if self.around is not None:
            return
        if self.gap and data:
            if self.parts and data[0].isalnum():
                self.parts.append(" ")
            self.gap = False
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, int]]:
        """The lines, each with the region that it belongs to in the end."""
        self.close()
        self._cut()
        articles: dict[int, int] = {}
        for parent, kind, _, _ in self.regions:
            if kind == "article" and self.regions[parent][1] == "main":
                articles[parent] = articles.get(parent, 0) + 1
        into = list(range(len(self.regions)))
        for i, (parent, kind, chars, linked) in enumerate(self.regions):
            one = kind == "article" and articles.get(parent) == 1
            if one or kind == "list" and 2 * linked <= chars:
                into[i] = into[parent]
        lines = [(text, tags, mark, into[region]) for text, tags, mark, region in self.lines]
        if lines and all(mark < PLAIN for _, _, mark, _ in lines):
            lines = [(text, tags, PLAIN if mark == OUT else mark, region) for text, tags, mark, region in lines]
        return lines


def line_values(lines: list[tuple[str, int, int, int]]) -> list[float]:
    """Text length per tag, steered by the marks."""
    outside = OUTSIDE if any(mark == IN for _, _, mark, _ in lines) else 1.0
    return [0.0 if mark < PLAIN else len(text) / max(1, tags) * (1.0 if mark == IN else outside) for text, tags, mark, _ in lines]


def smoothed(values: list[float], marks: list[int], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing along runs of equal marks, renormalised at their ends."""
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(radius + 1)]
    out = []
    for i, mark in enumerate(marks):
        total, weight = values[i], 1.0
        for step in (-1, 1):
            for d in range(1, radius + 1):
                j = i + step * d
                if not 0 <= j < len(marks) or marks[j] != mark:
                    break
                total += kernel[d] * values[j]
                weight += kernel[d]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of the two centres of one-dimensional two-means."""
    low, high = min(values), max(values)
    while True:
        mid = (low + high) / 2
        under, over = [v for v in values if v < mid], [v for v in values if v >= mid]
        a = sum(under) / len(under) if under else low
        b = sum(over) / len(over) if over else high
        if abs(a - low) + abs(b - high) < 1e-9 * max(1.0, high):
            return mid
        low, high = a, b


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines:
        return ""
    values = smoothed(line_values(lines), [mark for _, _, mark, _ in lines])
    cut = threshold(values)
    chars: dict[int, int] = {}
    worth: dict[int, float] = {}
    marked: dict[int, int] = {}
    for (text, _, mark, region), v in zip(lines, values):
        if mark >= PLAIN:
            chars[region] = chars.get(region, 0) + len(text)
            worth[region] = worth.get(region, 0.0) + len(text) * v
            if mark == IN:
                marked[region] = marked.get(region, 0) + len(text)
    kept = {r for r in chars if worth[r] > 0 and worth[r] >= cut * chars[r] * (1 - 1e-9)}
    if marked:
        kept.add(min(marked, key=lambda r: (-marked[r], r)))
    return "\n".join(text for text, _, mark, region in lines if mark >= PLAIN and region in kept)


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(h) for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    narrow = df.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long") \
        .select(F.col("_id").alias(id_col), F.col("_url").alias(url), "text", "n_chars")
