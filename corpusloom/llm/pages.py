"""Main-text extraction from HTML by line-block distribution.

The markup is stripped into lines: every block-level tag ends a line, and a subtree that
can't be article text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts, styles) leaves ``GAP`` empty lines in its place.  The length of the block
at line i is the sum of the text lengths over lines i to i + ``WINDOW`` - 1.  Text surges at a line
whose own length starts a run of positive blocks and dives where blocks fall to zero; each
surge and its dive bound a region.  Regions on both sides of a removed subtree are one if the lines
next to it stand in the same container.  A region is kept if its peak block reaches ``SHARE`` of the highest
peak of the page, where the length of a block counts without its link text, and lines of ``LINKED`` link text or more count as empty.

An ``article`` or ``main`` element is a prior, not a verdict: it begins and ends regions, link text counts
inside it, and a region inside needs ``SHARE_INSIDE`` only.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

WINDOW = 3
GAP = WINDOW
SHARE = 0.15
SHARE_INSIDE = SHARE / 2
LINKED = 0.8

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ENDS = re.compile(r"[\"'<>]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas video audio textarea select title head xmp noframes".split())
_LITERAL = frozenset("script style textarea title xmp iframe noframes".split())
_JUNK = frozenset("nav header footer aside form button fieldset dialog menu".split())
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_JUNK_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-bar|widget|footer|footnotes?-nav|header|masthead|topbar|cookies?|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|signup|login|comments?|comment-?list|respond|disqus|replies|reply|share|sharing|social|related|recommended|pagination|pager|toolbar|search|skip-link|copyright|legal)(?![a-z])",
    re.I,
)
_CONTAINERS = frozenset("body main article section div".split())
#: Names that tell a state or a subject of an article, not what it is.
_STATES = re.compile(r"(?<!\S)(?:category|tag|has|no|with|status|type|format)-\S+", re.I)
_MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|article-?body|main|content|post|entry|story|body)(?![a-z])", re.I)


def _junk(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _RAW or (tag in _JUNK and not (tag == "header" and in_article)):
        return True
    if not attributes:
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in _JUNK_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    names = " ".join((found.get("class", ""), found.get("id", "")))
    if tag == "article":
        names = _STATES.sub("", names)
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", names)
    return bool(_JUNK_WORDS.search(names)) and not (_MAIN_WORDS.search(names) and not re.search(r"comment|sidebar|nav|menu|foot|ad", names, re.I))


@functools.cache
def _literal_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


class _Markup:
    """Finds where the markup that begins at a less-than sign ends, in time linear in the page for all of them together."""

    def __init__(self, page: str):
        self.page = page
        self.unquoted = {}  # quote sign -> where its last one is behind

    def tag(self, low: int) -> tuple[int, str, bool, str, bool] | None:
        """(end, name, closing, attributes, empty) of a tag; None if no name follows.

        A tag ends at the first ``>`` outside quotes or before the first ``<`` outside them; a quote that never ends is an ordinary sign.
        """
        page = self.page
        m = _NAME.match(page, low + 1)
        if not m:
            return None
        at = first = m.end()
        while True:
            e = _ENDS.search(page, at)
            if not e:
                stop = end = len(page)
                break
            if e[0] in "<>":
                stop, end = e.start(), e.end() if e[0] == ">" else e.start()
                break
            at = e.end()
            if self.unquoted.get(e[0], at + 1) > at:
                close = page.find(e[0], at)
                if close < 0:
                    self.unquoted[e[0]] = at
                else:
                    at = close + 1
        attributes = page[first:stop]
        empty = attributes.endswith("/")
        return end, m[2].lower(), m[1] == "/", attributes[:-1] if empty else attributes, empty

    def other(self, low: int) -> tuple[int, str]:
        """(end, text) of a comment, a declaration or a section of characters, which alone has text."""
        page = self.page
        for opened, closed, text in (("<!--", "-->", False), ("<![CDATA[", "]]>", True), ("<", ">", False)):
            if page.startswith(opened, low):
                first = low + len(opened)
                stop = page.find(closed, first)
                stop, end = (len(page), len(page)) if stop < 0 else (stop, stop + len(closed))
                return end, page[first:stop] if text else ""
        raise ValueError("no markup here")


class _Line:
    __slots__ = ("text", "linked", "inside", "container")

    def __init__(self, text: str = "", linked: int = 0, inside: bool = False, container: int = 0):
        self.text, self.linked, self.inside, self.container = text, linked, inside, container


def lines_of(page: str, lists: bool = True) -> list[_Line]:
    """The page's lines after stripping; without ``lists``, no names of tags, roles and classes tell what is an article and what isn't."""
    markup = _Markup(page)
    junk = _junk if lists else lambda tag, attributes, in_article: tag in _RAW
    lines: list[_Line] = []
    parts: list[str] = []
    state = {"linked": 0}
    links = article = 0
    opened: list[tuple[str, int]] = []
    n_containers, n_opened = 0, dict.fromkeys(_CONTAINERS, 0)
    skip: str | None = None
    depth = 0

    def end_line(gap: int = 0) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append(_Line(text, min(state["linked"], len(text)), article > 0, opened[-1][1] if opened else 0))
        parts.clear()
        state["linked"] = 0
        lines.extend(_Line() for _ in range(gap))

    def add(text: str) -> None:
        if text and skip is None:
            parts.append(text)
            if links:
                state["linked"] += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            add(page[at:])
            break
        add(page[at:low])
        if page.startswith(("<!", "<?"), low):
            at, text = markup.other(low)
            if text:
                add(html.escape(text))
            continue
        found = markup.tag(low)
        if not found:  # a less-than sign
            add("<")
            at = low + 1
            continue
        at, tag, closing, attributes, empty = found
        empty = empty or tag in _VOID
        if skip not in (None, tag) and not closing and tag in ("article", "main") and not junk(tag, attributes, False):  # what is dropped was never closed
            skip = None
        if skip is not None:  # inside a subtree that is dropped: wait for its end
            if tag == skip and not empty:
                depth += -1 if closing else 1
                if not depth:
                    skip = None
            elif closing and tag in ("body", "html"):
                skip = None
            continue
        if not closing and junk(tag, attributes, article > 0):
            if tag not in _INLINE:
                end_line(GAP)
            if tag in _LITERAL:
                stop = _literal_end(tag).search(page, at)
                at = stop.end() if stop else n
            elif not empty:
                skip, depth = tag, 1
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + (not empty)
        if lists and tag in ("article", "main"):
            end_line(GAP if article == closing else 0)  # the outermost begins or ends
            if closing:
                article = max(0, article - 1)
            elif not empty:
                article += 1
        elif tag not in _INLINE:
            end_line()
        if tag in _CONTAINERS:
            if not closing and not empty:
                n_containers += 1
                opened.append((tag, n_containers))
                n_opened[tag] += 1
            elif closing and n_opened[tag]:
                while True:
                    last, _ = opened.pop()
                    n_opened[last] -= 1
                    if last == tag:
                        break
    end_line()
    return lines


def main_text(page: str | None, lists: bool = True) -> str:
    """The main text of a page: blocks in page order, joined by line feeds; empty if there is none.

    Without ``lists`` the distribution of text and links alone decides, as a measure of what it does.
    """
    if not page:
        return ""
    lines = lines_of(page, lists)
    weight = [len(x.text) if x.inside else 0 if x.linked >= LINKED * len(x.text) else len(x.text) - x.linked for x in lines]
    n = len(lines)
    block = [sum(weight[i : i + WINDOW]) for i in range(n)]
    regions, i = [], 0
    while i < n:
        if not weight[i]:  # no surge
            i += 1
            continue
        first = i
        while i < n and block[i]:
            i += 1
        peak = max(block[first:i])  # the dive
        if regions:
            before, stop, highest = regions[-1]
            a, b = lines[stop - 1], lines[first]
            if a.inside == b.inside and a.container == b.container and not any(x.text for x in lines[stop:first]):
                regions[-1] = (before, i, max(highest, peak))
                continue
        regions.append((first, i, peak))
    top = max((peak for _, _, peak in regions), default=0)
    return "\n".join(x.text for first, last, peak in regions if peak >= (SHARE_INSIDE if lines[first].inside else SHARE) * top for x in lines[first:last] if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page, one row for each row of ``pages``.

    A null or empty page, and one without main text, has the empty text.  page_id and url pass
    unchanged, null or not; repeated rows stay repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.record_batch([part.column("page_id"), part.column("url"), text], ["page_id", "url", "text"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
