"""Main text of web pages from streaming parser events.

Method: the standard library's parser sends events; text between two block
boundaries is a line, and each line has a text-to-tag ratio (characters
outside links by tags met).  The ratios of a page, smoothed with a Gaussian
kernel over neighbouring lines, are split into two clusters; lines of the high
cluster are content.  The smallest element that holds most content characters
is the content region, grown to an element around it while that adds content,
and the region's lines are the text, short ones too.  Elements that are no part
of an article by name (menus, footers, sidebars, scripts) and reader comments
never give a line, wherever they stand.  A class word (advert, related, widget),
a form or a role is evidence only: a block that has one and yet holds most of a
page's text is a wrapper around the article.  Class names that tell a state
(comments-open, has-sidebar, ad-free, overflow-hidden) are no evidence.  Work is linear in the page,
however deep its elements are nested.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ready

#: Standard deviation of the Gaussian kernel, in lines.
SIGMA = 1.0
#: Share of the content characters that the region must hold.
REGION_SHARE = 0.6
#: The region grows to an element around it that adds this share of the content characters, in sentences of so many characters.
GROWTH, SENTENCE = 0.1, 80

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("script style noscript template head title nav footer aside button select option textarea input svg math iframe object embed canvas audio video dialog menu fieldset".split())
_MAIN = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo menu menubar toolbar".split())
_WEAK_ROLES = frozenset("complementary search dialog alert alertdialog form status".split())
_STATES = frozenset("has is no not with without open opened closed enabled disabled allowed on off free how to overflow visible count".split())
_CLASSES = frozenset(
    "nav navbar navigation menu submenu menubar sidebar sidebars aside footer masthead banner ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager comments comment commentlist replies reply respond disqus widget widgets toolbar copyright disclaimer paywall search hidden".split()
)
_COMMENTS = frozenset("comments comment commentlist replies reply respond disqus".split())
#: A form or an element with a weak role must hold this share of a page's text to be a wrapper.
FORM_SHARE = 0.8
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption details".split())
_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_TWINS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACES = re.compile(r"\s+")


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """Why an element is no part of an article: '', 'name', 'comments', 'header', 'form' or 'class'."""
    if tag in _NEVER:
        return "name"
    a = dict(attrs)
    role = (a.get("role") or "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower() or role in _ROLES:
        return "name"
    if tag in ("html", "body"):
        return ""
    words = set()
    for name in ("class", "id"):
        for item in (a.get(name) or "").split():
            parts = {x.lower() for x in _SPLIT.split(item[:1].lower() + item[1:]) if x}
            if tag in _MAIN:  # an article falls to a whole name of a comment only
                words |= _COMMENTS & {item.lower()}
            elif not parts & _STATES:
                words |= parts
    if words & _COMMENTS:
        return "comments"
    if tag in _MAIN:
        return ""
    if tag == "form" or role in _WEAK_ROLES:
        return "form"
    if "header" in words:
        return "header"
    return "class" if words & _CLASSES else ""


class _Lines(HTMLParser):
    """Collects (text, link characters, tags, element) for each line, and (tag, parent, why doubtful) for each element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # [tag, element, why excluded, whether closed]
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of elements that are not inline
        self.elements: list[tuple[str, int, str]] = []
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.links = self.tags = 0

    def _why(self) -> str:
        return self.stack[-1][2] if self.stack else ""

    def _last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _flush(self) -> None:
        if self.parts:
            text = _SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.links, self.tags, self.stack[-1][1] if self.stack else -1))
            self.parts = []
        self.links, self.tags = 0, 0

    def _pop_to(self, depth: int) -> None:
        self._flush()
        while len(self.stack) > depth:
            tag, _, _, closed = self.stack.pop()
            if not closed:
                self.open[tag].pop()
                if tag not in _INLINE:
                    self.blocks.pop()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            if tag not in _INLINE:
                self._flush()
            self.tags += 1
            return
        if tag in _CLOSES_P and self.blocks and self._last("p") == self.blocks[-1]:
            self._pop_to(self.blocks[-1])
        if tag in _SIBLINGS:
            own = self._last(*_TWINS.get(tag, (tag,)))
            if own > self._last(*_SIBLINGS[tag]):
                self._pop_to(own)
        if tag not in _INLINE:
            self._flush()
        self.tags += 1
        above, own = self._why(), _boilerplate(tag, attrs)
        inside = self._last(*_MAIN) >= 0
        if above in ("name", "comments"):
            why = above
        elif own in ("name", "comments"):
            why = own
        elif tag in _MAIN or above == "header" and inside and tag in _HEADINGS:
            why = ""  # an article inside a header, and the headline in an article's own header
        else:
            why = above or ("header" if tag == "header" else "")
        self.elements.append((tag, self.stack[-1][1] if self.stack else -1, own if own in ("class", "header", "form") else ""))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append([tag, len(self.elements) - 1, why, False])

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        self.tags += 1
        at = self._last(tag)
        if at < 0:  # an end tag that nothing opened is ignored
            return
        if tag not in _INLINE:
            self._pop_to(at)
        elif not self.blocks or at > self.blocks[-1]:
            self.open[tag].pop()
            self.stack[at][3] = True
            while self.stack and self.stack[-1][3]:
                self.stack.pop()

    def handle_data(self, data: str) -> None:
        if not self._why():
            self.parts.append(data)
            if self.open.get("a"):
                self.links += len(data.strip())

    def close(self) -> None:
        super().close()
        self._flush()


def _below(elements: list[tuple[str, int, str]], lines: list, mass: list[float]) -> list[float]:
    """What the lines below each element weigh; the last entry is the whole page."""
    out = [0.0] * (len(elements) + 1)
    for line, m in zip(lines, mass, strict=True):
        out[line[3]] += m
    for e in range(len(elements) - 1, -1, -1):
        out[elements[e][1]] += out[e]
    return out


def _within(elements: list[tuple[str, int, str]], root: int) -> list[bool]:
    """Whether each element is ``root`` or below it; the last entry is the page itself."""
    out = [False] * len(elements) + [root < 0]
    for e, (_, parent, _) in enumerate(elements):
        out[e] = e == root or out[parent]
    return out


def _kept(parser: _Lines) -> list[tuple[str, int, int, int]]:
    """The lines outside doubtful elements, but for those that hold most of the page's text.

    Where an article stands outside all doubtful elements, only those in it or around it can do so.
    """
    elements, lines = parser.elements, parser.lines
    if not any(why for _, _, why in elements):
        return lines
    below = _below(elements, lines, [max(0, len(t) - links) for t, links, _, _ in lines])

    def reasons(pardoned: set[int]) -> tuple[list[str], list[bool]]:
        reason, inside = [""] * (len(elements) + 1), [False] * (len(elements) + 1)
        for e, (tag, parent, why) in enumerate(elements):
            above = reason[parent]
            own = "" if e in pardoned else why
            inside[e] = inside[parent] or tag in _MAIN
            if own in ("class", "form"):
                reason[e] = own
            elif not (tag in _MAIN or above == "header" and inside[parent] and tag in _HEADINGS):
                reason[e] = above or own
        return reason, inside

    reason, inside = reasons(set())
    mains = {e for e, (tag, _, _) in enumerate(elements) if tag in _MAIN and not reason[e] and below[e]}
    around: set[int] = set()
    for e in mains:
        while e >= 0 and e not in around:
            around.add(e)
            e = elements[e][1]
    pardoned = set()
    for e, (_, _, why) in enumerate(elements):
        share = FORM_SHARE if why == "form" else REGION_SHARE
        if why and below[e] >= share * below[-1] and (not mains or e in around or inside[e] and why != "form"):
            pardoned.add(e)
    if pardoned:
        reason, _ = reasons(pardoned)
    return [line for line in lines if not reason[line[3]]]


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """``values`` convolved with a normalised Gaussian kernel; edges use what there is of it."""
    half = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[half : half + len(values)] / np.convolve(np.ones(len(values)), kernel)[half : half + len(values)]


def two_clusters(values: np.ndarray) -> float:
    """Threshold halfway between the means of two clusters (one-dimensional 2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        up = values >= cut
        if up.all() or not up.any():
            break
        new = float(values[~up].mean()), float(values[up].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str | None) -> str:
    """The main text of one page; '' for null, empty or textless html."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, elements = _kept(parser), parser.elements
    if not lines:
        return ""
    ratio = np.array([max(0, len(t) - links) / max(1, tags) for t, links, tags, _ in lines])
    smooth = smoothed(ratio)
    content = smooth >= two_clusters(smooth)
    mass = np.where(content, [max(0, len(t) - links) for t, links, _, _ in lines], 0)
    if not mass.sum():
        mass = np.array([len(t) for t, _, _, _ in lines])
    below = _below(elements, lines, mass.tolist())
    wanted = REGION_SHARE * below[-1]
    region = max((e for e, (tag, _, _) in enumerate(elements) if tag in _MAIN and below[e] >= wanted), default=-1)
    if region < 0:
        region = max((e for e, (tag, _, _) in enumerate(elements) if below[e] >= wanted and tag not in _INLINE and tag not in _LEAVES), default=-1)
    region = _grown(region, elements, lines, content, below[-1])
    within = _within(elements, region)
    inside = [i for i, line in enumerate(lines) if within[line[3]]]
    if region < 0 or elements[region][0] not in _MAIN:  # no element says where the article ends: cut link lists and notices at its edges
        keep = [i for i in inside if content[i]]
        first, last = (keep[0], keep[-1]) if keep else (inside[0], inside[-1])
        whole = region >= 0 and elements[region][0] not in ("html", "body")

        def belongs(i: int) -> bool:
            """Whether a line beside the content is part of it: not a link or notice; in a body, a sentence or text of a paragraph, list or heading."""
            line = lines[i]
            return not _links(line) and not _NOTICE.match(line[0]) and (whole or _sentence(line) or elements[line[3]][0] in _LEAVES)

        for i in reversed([i for i in inside if i < first]):
            if not belongs(i):
                break
            first = i
        for i in inside:
            if i > last and (_sentence(lines[i]) or i == last + 1 and belongs(i)):
                last = i
        inside = [i for i in inside if first <= i <= last]
    return " ".join(lines[i][0] for i in inside)


def _grown(region: int, elements: list[tuple[str, int, str]], lines: list, content: np.ndarray, whole: float) -> int:
    """The outermost element around a region that adds content sentences of ``GROWTH`` of the page's content."""
    long = [len(x[0]) - x[1] if c and len(x[0]) >= SENTENCE and _sentence(x) else 0 for x, c in zip(lines, content, strict=True)]
    below = _below(elements, lines, long)
    at, grown = region, region
    while at >= 0:
        at = elements[at][1]
        if below[at] - below[grown] >= max(GROWTH * whole, 1):
            grown = at
    return grown


_LEAVES = frozenset("p li td th tr h1 h2 h3 h4 h5 h6 dt dd pre blockquote figcaption caption".split())
_NOTICE = re.compile(r"\s*(©|\(c\)|copyright\b|all rights reserved|cookie)", re.I)


def _links(line: tuple[str, int, int, int]) -> bool:
    return 2 * line[1] > len(line[0])


def _sentence(line: tuple[str, int, int, int]) -> bool:
    return not _links(line) and not _NOTICE.match(line[0]) and line[0][-1:] in ".!?…\"'”»)"


def _run(batches):
    for batch in batches:
        text = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    One pass, no shuffle; a page is parsed whole, so a task holds one batch of
    pages.  Null or empty html, and pages without article text, give '' and 0.
    Repeated rows give repeated results.  Other columns are ignored; an empty
    table gives an empty result.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
