"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block element. A line weighs the characters of its text outside
links. Elements and class words change weights: lines of zones that hold no article text (menus, headers,
footers, sidebars, forms, adverts, notices, reader comments) weigh nothing; where a page has an
``article`` or ``main`` element, links inside it count as text and lines outside weigh nothing.

On every page weights are summed over sliding windows of WINDOW lines, and the level is LEVEL characters or
a quarter of the page's largest window, whichever is less. Text surges where a window's sum first passes
the level, and dives for good where no later one does. As a short title or last paragraph may lie just
outside, the ends move on over lines of the containers in which the text lies (of the same ``article``, or
innermost ``div`` or ``section``) and over headings right before, until a line weighs nothing. All lines
between the ends that are in no zone are kept, in page order, however short.

A class or id marks a zone if, fillers such as ``box`` or ``top`` apart, all its words name one ("ad", "cookie-bar").
Where only some do ("form-factor"), or where a word has other uses too ("legal"), the mark is a doubt: its lines weigh
nothing outside an ``article``, but inside the text they stay if most of their characters lie outside links.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by a line feed. Nothing else is dropped. A null or empty page has an empty text; a very long page is read
whole; repeated rows get a row each; an empty table gives no rows; columns not named are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
LEVEL = 86

# Elements whose content is never text.
_SILENT = "script|style|noscript|template|svg|math|title|textarea|select|option|button|iframe|object|canvas|audio|video"
# Elements that hold no article text.
_ZONES = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "head"}
# Words of a class or id that mark such a zone.
_ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager "
    "comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget copyright disclaimer legal form search".split()
)
# Those of them that article text is marked with as well.
_DOUBTFUL_WORDS = frozenset("legal form search header widget".split())
# Words beside them that change nothing.
_FILLERS = frozenset(
    "site page main list box block container wrapper wrap area section inner outer unit slot top bottom left right "
    "item items link links bar button buttons posts global primary secondary js id the of".split()
)
_ZONE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_CONTAINERS = {
    "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "menu", "dialog", "ul", "ol", "dl",
    "table", "body", "html", "head", "blockquote", "figure", "fieldset", "details",
}
# Containers whose lines belong together.
_HOMES = {"div", "section", "article", "main"}
_BREAKS = _CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption",
    "pre", "hr", "figcaption", "address", "summary", "legend", "center",
}
_MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{_SILENT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z/][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.IGNORECASE)
_HREF = re.compile(r"""(?<![\w-])href\s*=""", re.IGNORECASE)
_PIECE = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


CLEAR, DOUBT, ZONE = 0, 1, 2


class Line(NamedTuple):
    text: str
    weight: int
    in_article: bool
    # CLEAR, DOUBT or ZONE.
    mark: int
    # The container whose text the line is; 0 for the page itself.
    home: int
    heading: bool
    # Whether most characters lie outside links.
    reads: bool


def _mark_of(name: str, attributes: str, in_article: bool) -> int:
    if name in _ZONES and not (name == "header" and in_article):
        return ZONE
    if not attributes or name in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return CLEAR
    role = _ROLE.search(attributes)
    if role and role[1].lower() in _ZONE_ROLES:
        return ZONE
    mark = CLEAR
    for value in _NAMES.findall(attributes):
        for word in value.strip("\"'").split():
            pieces = {piece.lower() for piece in _PIECE.findall(word)}
            named = pieces & _ZONE_WORDS
            if named - _DOUBTFUL_WORDS and pieces <= _ZONE_WORDS | _FILLERS:
                return ZONE
            mark = max(mark, DOUBT if named else CLEAR)
    return mark


def lines(page: str) -> list[Line]:
    """Lines of a page in their order."""
    out: list[Line] = []
    # Open containers as (name, mark, whether it is an article, home).
    stack: list[tuple[str, int, bool, int]] = []
    # Open zones and doubts; the mark of the open block that is no container.
    open_marks = [0, 0, 0]
    articles = homes = 0
    block_mark = CLEAR
    links, linked = 0, 0
    # The open block that is no container; the one the link began in, and blocks opened since.
    block_name = link_in = None
    link_depth = 0
    parts: list[str] = []

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                mark = max(block_mark, ZONE if open_marks[ZONE] else DOUBT if open_marks[DOUBT] else CLEAR)
                plain = max(0, len(text) - linked)
                # In an article a link is part of the text, and a doubt weighs half.
                weight = len(text) if articles else plain
                if mark:
                    weight = (weight + 1) // 2 if mark == DOUBT and articles else 0
                heading = block_name is not None and len(block_name) == 2 and block_name[1].isdigit()
                home = stack[-1][3] if stack else 0
                out.append(Line(text, weight, articles > 0, mark, home, heading, 2 * plain > len(text)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(" ".join(html.unescape(text).split()))

    at = 0
    for mark in _MARK.finditer(page):
        if mark.start() > at:
            add(page[at : mark.start()])
        at = mark.end()
        name = mark["name"]
        if name is None:
            continue
        name, attributes = name.lower(), mark["attributes"] or ""
        if name == "br":
            parts.append(" ")
        if name == "a":
            # A named place is no link.
            links = int(not mark["end"] and bool(_HREF.search(attributes)))
            link_in, link_depth = block_name, 0
        if name in _BREAKS:
            end_line()
            # A link that is not closed ends with the block it began in.
            if mark["end"]:
                links = links if link_depth else 0
                link_depth = max(0, link_depth - 1)
                block_name = None
            elif name == link_in:
                links = 0
            elif name != "hr":
                link_depth += 1
            if not mark["end"]:
                block_name = None if name in _CONTAINERS or name == "hr" else name
        if name in _CONTAINERS:
            block_mark = CLEAR
            if not mark["end"]:
                found = _mark_of(name, attributes, articles > 0)
                article = name in ("article", "main") and found == CLEAR
                home = stack[-1][3] if stack else 0
                # All of an article is one home; what is in doubt, or only sets out text, is of the home around it.
                if not articles and name in _HOMES and found != DOUBT:
                    homes += 1
                    home = homes
                stack.append((name, found, article, home))
                open_marks[found] += 1
                articles += article
            elif any(name == opened for opened, *_ in stack):
                while True:
                    opened, found, article, _ = stack.pop()
                    open_marks[found] -= 1
                    articles -= article
                    if opened == name:
                        break
        elif name in _BREAKS:
            # A block that names itself a zone is one until any block begins or ends.
            block_mark = _mark_of(name, attributes, articles > 0) if not mark["end"] and attributes else CLEAR
    if at < len(page):
        add(page[at:])
    end_line()
    return out


def main_text(page: str | None, window: int = WINDOW, level: int = LEVEL) -> str:
    """Kept lines of a page, joined by line feeds."""
    found = lines(page or "")
    has_article = any(line.in_article and line.weight for line in found)
    weights = [line.weight if line.in_article or not has_article else 0 for line in found]
    padded = weights + [0] * (window - 1)
    sums = [sum(padded[i : i + window]) for i in range(len(weights))]
    level = min(level, max(sums, default=0) // 4)
    above = [i for i, total in enumerate(sums) if total > level]
    if not above:
        return ""
    # The text goes from the first surge to the last dive.
    text = [i for i in range(above[0], min(above[-1] + window, len(found))) if weights[i]]
    homes = {found[i].home for i in text}

    def of_text(i: int) -> bool:
        line = found[i]
        if line.mark == ZONE or has_article and not line.in_article:
            return False
        return line.mark == CLEAR or line.reads and line.home in homes

    def end(at: int, step: int) -> int:
        last = at
        while 0 <= at + step < len(found):
            at += step
            line = found[at]
            if line.mark == ZONE:
                continue
            same = line.home in homes and line.home and (weights[at] or line.mark == DOUBT and line.reads)
            if not (of_text(at) and (same or step < 0 and line.heading and weights[at] and at == last - 1)):
                break
            last = at
        return last

    first, last = end(text[0], -1), end(text[-1], 1)
    return "\n".join(found[i].text for i in range(first, last + 1) if of_text(i))


def extract(pages: DataFrame, key: str = "page_id", content: str = "html") -> DataFrame:
    """``key``, ``url`` and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, "url", "text"])

    wanted = pages.select(key, "url", content)
    kinds = [f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in (key, "url")]
    return wanted.mapInArrow(run, ", ".join([*kinds, "text string"]))
