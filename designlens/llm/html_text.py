"""Main text of HTML pages by text-to-tag ratios of lines.

A streaming parser turns a page into lines: the text between two block-level
tags. Each line has its ratio of characters to tags inside it (at least one).
Ratios are smoothed along the page with a Gaussian, and their values are split
into two clusters (content and rest) by iterated means. The clusters decide

* which containers are content regions, in pages without an ``article`` or
  ``main``: those that directly hold a content line that is not mostly links;
  their other lines (titles, short paragraphs) come with them;
* which runs of links inside an article are menus: three or more lines in a row
  that are links alone and lie in the rest;
* whether an element whose class looks like boilerplate is the page's frame: one
  that holds more than half of the page's content is kept.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
by element name, class, id or role, are dropped, but not an element around the
page's only articles (a frame of class ``no-sidebar``, a page-wide form, a menu
that is never closed). All articles of a page are kept, and what stands in
``main`` outside of them.

Defined results: null and empty pages have empty text. Markup that is cut off,
wrongly nested or never closed is read as far as it goes; an end tag closes the
elements opened after its start tag. Pages are judged one by one, so repeated
rows get equal results, whole and at any length; of equal ratios all lie in one
cluster, and a page whose lines all have one ratio is content. An empty table
gives an empty one. Only ``page_id``, ``url`` and ``html`` are read, so further
columns and their names have no effect.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designlens.llm.columns import arrow_map, slices

# Element names, and words of class, id and role attributes.
SILENT = set("audio button canvas datalist embed head iframe input map noscript object option script select style svg annotation annotation-xml template textarea video".split())
FRAMES = set("aside dialog footer form header menu nav".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math merror mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SCOPES = {"article", "main"}
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|byline|consent|cookie|cookies|dialog|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|related|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Those that say enough even inside an article.
PLAIN = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|breadcrumb|breadcrumbs|consent|cookie|cookies|modal|navbar|newsletter|pager|pagination|popup|promo|promoted|sidebar|signup|sponsor|sponsored|subscribe|widget)(?:$|[\s_-])",
    re.I,
)
ROLES = {"banner", "navigation", "complementary", "contentinfo", "search", "form", "dialog", "alert", "menu"}
#: Paragraphs that a start tag ends.
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that hold one line of their container.
LEAVES = set("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre table tbody td tfoot th thead tr ul".split())
#: Elements that an article's own text stands in: there a class or id makes no boilerplate of them.
TEXTUAL = (LEAVES | INLINE) - {"dl", "ol", "ul"}

#: Link lines in a row that make a menu if they have so many words or fewer on average (a list of references has more),
#: and the share of a page's content that makes an element its frame.
MENU_LINES, MENU_WORDS, FRAME_SHARE = 3, 3, 0.5


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    container: int
    frames: tuple[int, ...]  # elements around it that look like boilerplate
    scopes: tuple[int, ...]  # articles around it


class Lines(HTMLParser):
    """Lines of a page, and the elements around them that matter."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: Of each frame: whether its class alone says so, whether it holds reader comments, and the articles in it.
        self.by_class: list[bool] = []
        self.comments: list[bool] = []
        self.around: list[tuple[int, ...]] = []
        #: Frames inside an article that only a word of their class or id makes: the clusters decide on them.
        self.doubtful: set[int] = set()
        self._open: list[str] = []
        self._times: dict[str, int] = {}
        self._silent: list[int] = []
        self._frames: list[tuple[int, int]] = []
        self._scopes: list[tuple[int, int]] = []
        self._containers: list[tuple[int, int]] = [(-1, 0)]
        self._known: tuple[tuple[int, ...], tuple[int, ...]] | None = ((), ())
        self._text: list[str] = []
        self._tags, self._linked, self._count, self._made = 0, 0, 0, 0

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def cut(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text and not self._silent:
                if self._known is None:
                    self._known = (tuple(i for _, i in self._frames), tuple(i for _, i in self._scopes))
                self.lines.append(Line(text, self._tags or 1, self._linked, self._containers[-1][1], *self._known))
            self._text = []
        self._tags = self._linked = 0

    def _close(self, depth: int) -> None:
        for tag in self._open[depth:]:
            self._times[tag] -= 1
        del self._open[depth:]
        changed = False
        for stack in (self._frames, self._scopes, self._containers):
            while stack and stack[-1][0] >= depth:
                stack.pop()
                changed = True
        while self._silent and self._silent[-1] >= depth:
            self._silent.pop()
        if changed:
            self._known = None

    def _push(self, tag: str) -> None:
        self._open.append(tag)
        self._times[tag] = self._times.get(tag, 0) + 1

    def _last(self, tag: str) -> int:
        """The depth of the innermost open element ``tag``; -1 if there is none."""
        if not self._times.get(tag):
            return -1
        return next(i for i in range(len(self._open) - 1, -1, -1) if self._open[i] == tag)

    def _frame(self, tag: str, attrs) -> tuple[bool, bool, bool, bool]:
        """Whether a start tag opens a frame, whether its class or role alone says so, whether it holds comments, and whether only a word of its class or id says so, which may be the article's own."""
        said = comments = worded = plain = False
        for k, v in attrs:
            if k in ("class", "id") and v:
                comments |= COMMENTS.search(v) is not None
                worded |= BOILERPLATE.search(v) is not None
                plain |= PLAIN.search(v) is not None
            elif k == "role" and v:
                said |= v.lower() in ROLES
            elif k == "hidden" or k == "aria-hidden" and v == "true":
                said = True
        if worded and not said and not comments and tag in TEXTUAL and self._scopes:
            worded = False
        return tag in FRAMES or said or comments or worded, tag not in FRAMES, comments, worded and not (said or comments or plain or tag in FRAMES)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in INLINE:
            self._tags += 1
            if not attrs:
                if tag not in VOID:
                    self._push(tag)
                return
        else:
            self.cut()
        if tag in ENDS_P and self._times.get("p"):
            # not across an element that holds blocks of its own
            at = next(i for i in range(len(self._open) - 1, -1, -1) if self._open[i] in ENDS_P)
            if self._open[at] == "p":
                self._close(at)
        if tag in VOID:
            return
        depth = len(self._open)
        self._push(tag)
        if tag in SILENT:
            self._silent.append(depth)
            return
        frame, by_class, comments, worded = self._frame(tag, attrs) if attrs or tag in FRAMES else (False, False, False, False)
        if frame and tag not in ("html", "body") and (tag not in SCOPES or comments):
            if tag in INLINE:
                self.cut()
            self._frames.append((depth, len(self.around)))
            if worded and self._scopes:
                self.doubtful.add(len(self.around))
            self.by_class.append(by_class)
            self.comments.append(comments)
            self.around.append(())
        elif tag in SCOPES:
            self._count += 1
            self._scopes.append((depth, self._count))
            for _, i in self._frames:
                self.around[i] += (self._count,)
        if tag not in INLINE and tag not in LEAVES:
            self._made += 1
            self._containers.append((depth, self._made))
        self._known = None

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        # as browsers do, "<div/>" stays open; only void elements end at once

    def handle_endtag(self, tag) -> None:
        if tag in INLINE:
            self._tags += 1
            if self._open and self._open[-1] == tag and not self._frames and not self._silent:
                self._open.pop()
                self._times[tag] -= 1
            else:
                self._end(tag)
            return
        self.cut()
        self._end(tag)

    def _end(self, tag: str) -> None:
        depth = self._last(tag)
        if depth >= 0:
            if (self._frames and self._frames[-1][0] >= depth) or (self._silent and self._silent[-1] >= depth):
                self.cut()
            self._close(depth)

    def handle_data(self, data) -> None:
        self._text.append(data)
        if self._open and self._open[-1] == "a":
            self._linked += len(data)


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; beyond the ends nothing counts."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / weight


def split_threshold(values: np.ndarray) -> float:
    """Bound between two clusters: halfway between the means on both sides of it."""
    bound = float(values.mean())
    for _ in range(50):
        low, high = values[values < bound], values[values >= bound]
        new = (float(low.mean()) + float(high.mean())) / 2 if len(low) and len(high) else bound
        if abs(new - bound) < 1e-9:
            break
        bound = new
    return bound


def kept_frames(page: Lines, content: np.ndarray) -> set[int]:
    """Elements that look like boilerplate but are frames of the page's content."""
    every = {i for line in page.lines for i in line.scopes}
    free = {i for line in page.lines for i in line.scopes if not line.frames} | (every - {i for x in page.around for i in x})
    out = set()
    if not free:
        # all articles are inside such elements: those around them are no boilerplate, of comments only if nothing else is left
        plain = every - {i for x, c in zip(page.around, page.comments) if c for i in x}
        out = {k for k, x in enumerate(page.around) if (plain or every).intersection(x) and not (page.comments[k] and plain)}
    # an element inside an article that only its class or id speaks against stays if most of its text looks like content
    text: dict[int, list[int]] = {i: [0, 0] for i in page.doubtful}
    for line, c in zip(page.lines, content):
        for i in page.doubtful.intersection(line.frames):
            text[i][bool(c)] += len(line.text)
    out |= {i for i, (low, high) in text.items() if high > low}
    weight: dict[int, int] = {}
    total = 0
    for line, c in zip(page.lines, content):
        if c and all(page.by_class[i] for i in line.frames):
            total += len(line.text)
            for i in line.frames:
                weight[i] = weight.get(i, 0) + len(line.text)
    return out | {i for i, n in weight.items() if n > FRAME_SHARE * total and not page.comments[i]}


def main_text(html: str) -> str:
    """The main text of one page."""
    page = Lines()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.lines
    if not lines:
        return ""
    ratio = smoothed(np.log1p(np.array([len(x.text) / x.tags for x in lines])))
    content = ratio >= split_threshold(ratio)
    kept = kept_frames(page, content)
    open_ = [kept.issuperset(x.frames) for x in lines]
    if any(x.scopes and o for x, o in zip(lines, open_)):
        keep = [bool(x.scopes) and o for x, o in zip(lines, open_)]
        links = [k and not c and 10 * x.linked >= 9 * len(x.text) for x, k, c in zip(lines, keep, content)]
        first = 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not links[i]:
                if i - first >= MENU_LINES and sum(len(x.text.split()) for x in lines[first:i]) <= MENU_WORDS * (i - first):
                    keep[first:i] = [False] * (i - first)
                first = i + 1
    else:
        plain = [o and 2 * x.linked < len(x.text) for x, o in zip(lines, open_)]
        regions = {x.container for x, p, c in zip(lines, plain, content) if p and c}
        keep = [p and x.container in regions for x, p in zip(lines, plain)]
    return " ".join(x.text for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")
