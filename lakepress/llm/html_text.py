"""Main text of web pages by text-to-tag ratio (operator 5).

The standard library's parser is fed the page and streams its events. Text is gathered into lines, a line being what
stands between block-level tags; each line counts its characters and the tags met since the line before. Lines in
elements that are never content by tag, role or hidden state are left out (end tags may be implied, of left-out
elements too). The text-to-tag ratios of the other lines are smoothed with a Gaussian, and lines at or above a
threshold derived from their spread are content. A run of content lines takes the short lines along that belong to it
(`cluster`): those inside it, and headings and tails in its container. A page's marks (<article>, <main>) bound
clusters: ratios are not smoothed and runs do not go over their edges, and a mark in which any line is content, or
which holds half of the page's text, is kept whole but for marks within it, since its short paragraphs are content
too. What is outside is held against the same threshold.

A class or id only makes an element a suspect (`suspicion`); what the element holds decides (`side_parts`): a wrapper
with such a name that holds the article stays, and a name of which the word is only a part counts for elements that
are short or mostly links.

Defined results: null and empty pages, and pages without content, give the empty text; broken markup is read as far
as it goes; white space inside a block is one space, blocks are joined by one newline in page order; nothing is cut.
Time grows with the page's length however deep or broken its markup is: open elements are found by their tag, and
nested containers are kept as parent numbers.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("nav header footer aside form script style noscript template title head button select textarea iframe svg object canvas dialog menu option label fieldset audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name a side part. Names of comments are side parts even if they hold <article>s.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
SURE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox adsbox sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer foot masthead cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login pagination pager".split())
MAYBE = frozenset("banner banners side aside header notice notices notification alert overlay social share sharing related recommended recommendations widget widgets toolbar search copyright disclaimer legal".split())
MARKS = COMMENTS | SURE | MAYBE
#: Words that say nothing beside them: "site-footer" is a footer, "article-footnote" is none.
LAYOUT = frozenset("site page main top bottom left right box wrap wrapper container area block section inner outer list item items bar links primary secondary global".split())
#: After these a word of a name tells of the page, not of the element: "no-sidebar", "page-with-menu".
_NOT_OWN = frozenset("no not non has have with without hide hides show shows is sans".split())
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_OPEN_TAG = re.compile(r"<[A-Za-z/!?]")
#: A suspect of fewer characters is short.
SHORT = 200
#: Elements of running text: a side part's name among other names does not make them one.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: p is closed by these start tags.
_CLOSES_P = BLOCKS - {"br", "html", "body", "option", "optgroup", "title", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "noscript"}
#: What else a start tag closes.
_CLOSES = {
    **dict.fromkeys(_CLOSES_P, ("p",)), "li": ("p", "li"), "dd": ("p", "dd", "dt"), "dt": ("p", "dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr", "caption"), **dict.fromkeys(("tbody", "thead", "tfoot"), ("td", "th", "tr", "caption", "tbody", "thead", "tfoot")),
}
#: An implied end does not reach beyond these.
_HOLDS = frozenset("html body table button object template noscript canvas select svg audio video".split())
_HOLDS_BY = {"p": _HOLDS | {"td", "th", "caption"}, "li": _HOLDS | frozenset("td th caption ul ol menu dir dl article section main aside nav header footer form fieldset blockquote details figure".split()), "option": frozenset(["select", "datalist", "html", "body"])}
_HOLDS_BY |= {"dd": _HOLDS_BY["li"], "dt": _HOLDS_BY["li"], "optgroup": _HOLDS_BY["option"]}
SIGMA = 1.0

#: Elements that hold regions of a page: lists, tables and paragraphs belong to the one they are in.
CONTAINERS = frozenset("html body div section article main center details dialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How sure a name is.
WEAK, MAYBE_SO, SURELY, TALK = 0, 1, 2, 3


class Line(NamedTuple):
    text: str
    tags: int  # met since the line before
    mark: int  # number of the innermost <article> or <main>, 0 for none
    box: int  # number of the innermost container, 0 for none
    linked: int  # characters in links
    heading: bool
    aside: int  # number of the innermost suspect, 0 for none


class Tree:
    """Numbers of nested elements in page order, 0 for none; `up` has each one's parent."""

    def __init__(self) -> None:
        self.up = [0]
        self.now = 0
        self.depths: list[int] = []  # how deep each of the open ones stands

    def enter(self, depth: int) -> int:
        self.up.append(self.now)
        self.now = len(self.up) - 1
        self.depths.append(depth)
        return self.now

    def leave_beyond(self, depth: int) -> None:
        while self.depths and self.depths[-1] > depth:
            self.depths.pop()
            self.now = self.up[self.now]

    def sums(self, own: Counter) -> list[int]:
        """own's counts with those of all inside."""
        out = [own[k] for k in range(len(self.up))]
        for k in range(len(self.up) - 1, 0, -1):
            out[self.up[k]] += out[k]
        return out


class Page(HTMLParser):
    """Gathers the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}  # places in `open` of each tag
        self.off: int | None = None  # how deep the outermost element that is left out stands
        self.marks, self.boxes, self.asides = Tree(), Tree(), Tree()
        self.kinds = [WEAK]  # of each suspect
        self.running = [False]  # whether it is an element of running text
        self.titles: Counter = Counter()  # <h1>, <main> and, but in comments, <article> by suspect
        self.talks = 0  # open suspects that are comments
        self.tags = 0
        self.buf: list[str] = []
        self.linked = 0
        self.headings = 0

    def cut(self) -> None:
        if self.buf:
            text = " ".join("".join(self.buf).split())
            if text:
                self.lines.append(Line(text, self.tags, self.marks.now, self.boxes.now, self.linked, self.headings > 0, self.asides.now))
                self.tags = 0
            self.linked = 0
            self.buf.clear()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The end of a comment; one that is never closed reaches to the end of the page."""
        end = self.rawdata.find("-->", i + 4)
        return len(self.rawdata) if end < 0 else end + 3

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if self.buf:
                self.cut()
            for ended in _CLOSES.get(tag, ()):
                if self.at.get(ended):
                    self.leave(ended, _HOLDS_BY.get(ended, _HOLDS))
        self.tags += 1
        if tag in VOID:
            return
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        depth = len(self.open)
        if tag in CONTAINERS:
            self.boxes.enter(depth)
        self.headings += tag in _HEADINGS
        if self.off is None:
            inner = self.marks.now > 0 and tag == "header"  # an article's own header holds its title
            if (tag in NEVER and not inner) or hidden(attrs):
                self.off = depth
                return
            if tag == "article" or tag == "main":
                self.marks.enter(depth)
            elif attrs and tag != "body" and tag != "html" and (kind := suspicion(tag, attrs)) is not None:
                self.asides.enter(depth)
                self.kinds.append(kind)
                self.running.append(tag in _TEXT)
                self.talks += kind == TALK
            if tag == "h1" or tag == "main" or (tag == "article" and not self.talks):
                self.titles[self.asides.now] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def leave(self, tag: str, holds: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of the tag, left out or not, and all in it; unless one of `holds` stands between."""
        places = self.at.get(tag)
        if not places:
            return
        k = places[-1]
        if any(p[-1] > k for h in holds if (p := self.at.get(h))):
            return
        for t in self.open[k:]:
            self.at[t].pop()
            self.headings -= t in _HEADINGS
        del self.open[k:]
        self.boxes.leave_beyond(k)
        self.marks.leave_beyond(k)
        while self.asides.depths and self.asides.depths[-1] > k:
            self.talks -= self.kinds[self.asides.now] == TALK
            self.asides.leave_beyond(self.asides.depths[-1] - 1)
        if self.off is not None and k < self.off:
            self.off = None

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and self.buf:
            self.cut()
        self.tags += 1
        if tag not in VOID:
            self.leave(tag)

    def handle_data(self, data: str) -> None:
        if self.off is None:
            self.buf.append(data)
            if self.at.get("a"):
                self.linked += len(data.strip())


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def suspicion(tag: str, attrs: list[tuple[str, str | None]]) -> int | None:
    """How surely an element's names make it a side part; null if they do not at all."""
    best, others = None, False
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        for token in value.split():
            parts = [p.lower() for p in _PARTS.findall(token)]
            own = parts[: next((k for k, p in enumerate(parts) if p in _NOT_OWN), len(parts))]
            found = MARKS.intersection(own)
            others = others or (not found and name == "class")
            if found:
                whole = len(own) == len(parts) and all(p in MARKS or p in LAYOUT for p in parts)
                kind = WEAK if not whole else TALK if found & COMMENTS else SURELY if found & SURE else MAYBE_SO
                best = kind if best is None else max(best, kind)
    return WEAK if best is not None and others and tag in _TEXT else best


def side_parts(page: Page) -> list[bool]:
    """For each suspect whether it is a side part, by what it holds.

    One that holds a title, <main> or, unless it is comments, an <article> is none. Else comments and sure names are;
    other names are unless the element holds half of the page's text, not mostly links, on a page without a title
    elsewhere. Where the name is a part of a longer word or stands beside others, the element must be mostly links or,
    if it is no running text, short.
    """
    tree = page.asides
    chars, linked = Counter(), Counter()
    for x in page.lines:
        chars[x.aside] += len(x.text)
        linked[x.aside] += x.linked
    text, links, titles = tree.sums(chars), tree.sums(linked), tree.sums(page.titles)
    out = [False] * len(tree.up)
    for k in range(1, len(out)):
        listed = 2 * links[k] >= text[k]
        if out[tree.up[k]]:
            out[k] = True
        elif titles[k]:
            out[k] = False
        elif page.kinds[k] == WEAK:
            out[k] = listed or (text[k] < SHORT and not page.running[k])
        elif page.kinds[k] == MAYBE_SO:
            out[k] = listed or titles[0] > 0 or 2 * text[k] < text[0]
        else:
            out[k] = True
    return out


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel's rest is shared out."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


class Regions:
    """The containers of lines; one that holds a single line is none of its own. Regions are numbers of containers."""

    def __init__(self, lines: list[Line], tree: Tree):
        held = tree.sums(Counter(x.box for x in lines))
        self.of, self.depth = [0] * len(tree.up), [0] * len(tree.up)
        self.up = [0] * len(tree.up)
        self.last = list(range(len(tree.up)))  # the last number inside
        for k in range(1, len(tree.up)):
            above = self.of[tree.up[k]]
            own = tree.up[k] == 0 or held[k] > 1
            self.of[k] = k if own else above
            if own:
                self.up[k], self.depth[k] = above, self.depth[above] + 1
        for k in range(len(tree.up) - 1, 0, -1):
            self.last[tree.up[k]] = max(self.last[tree.up[k]], self.last[k])

    def beside(self, a: int, b: int) -> bool:
        """Whether two regions are one, or stand directly in one that is not the page's outermost, which may be one of them."""
        if a == b:
            return a > 0
        around = next((x for x, near in ((b, self.up[a] == b), (a, self.up[b] == a), (self.up[a], self.up[a] == self.up[b])) if near), 0)
        return self.depth[around] > 1

    def inside(self, a: int, b: int) -> bool:
        """Whether region a is b or in b."""
        return b <= a <= self.last[b]


def cluster(lines: list[Line], tree: Tree, raw: np.ndarray, ratio: np.ndarray, limit: float) -> np.ndarray:
    """Which lines are content: by their smoothed ratio, or as runs take along the lines that belong to them.

    A line that only its neighbours' ratios lift is no content if it is mostly links, and takes no others along. A gap
    between two content lines is closed where both stand in one container, or in ones directly in it; of other
    containers in the gap, lines that are mostly links stay out. Beyond its ends a run takes the lines of its end's
    container, as far as they are not mostly links, and headings right before it from the container around.
    """
    regions = Regions(lines, tree)
    box = [regions.of[x.box] for x in lines]
    listed = [2 * x.linked >= len(x.text) for x in lines]
    content = (ratio >= limit) & ((raw >= limit) | ~np.array(listed))
    out, seeds = content.copy(), np.flatnonzero(content & (raw >= limit)).tolist()
    for i, j in itertools.pairwise(seeds):
        if lines[i].mark == lines[j].mark and regions.beside(box[i], box[j]):
            for k in range(i + 1, j):
                out[k] = out[k] or lines[k].mark == lines[i].mark and (not listed[k] or box[k] in (box[i], box[j]))
    own_seeds = set(seeds)
    for step in (-1, 1):
        for i in seeds:
            own, k = box[i], i + step
            while 0 <= k < len(lines) and k not in own_seeds and not listed[k] and lines[k].mark == lines[i].mark and regions.inside(box[k], own):
                out[k] = True
                k += step
            while step < 0 <= k and lines[k].heading and not listed[k] and box[k] == regions.up[own]:
                out[k] = True
                k += step
    return out


def choose(page: Page) -> list[str]:
    """Lines of content regions by smoothed text-to-tag ratio."""
    side, lines, tags = side_parts(page), [], 0
    for x in page.lines:
        tags += x.tags
        if not side[x.aside]:
            lines.append(x._replace(tags=tags))
            tags = 0
    if not lines:
        return []
    raw = np.array([len(x.text) / max(1, x.tags) for x in lines])
    ratio = np.concatenate([smooth(raw[np.array([k for k, _ in part])]) for _, part in itertools.groupby(enumerate(lines), lambda x: x[1].mark)])
    limit = min(ratio.std(), ratio.mean()) if len(lines) > 2 else 0.0
    content = cluster(lines, page.boxes, raw, ratio, limit)
    size = Counter()
    for x in lines:
        size[x.mark] += len(x.text)
    total = size.total()
    chosen = {x.mark for x, keep in zip(lines, content, strict=True) if keep} | {m for m, n in size.items() if 2 * n >= total}
    whole: set[int] = set()
    for m in chosen:
        while m and m not in whole:
            whole.add(m)
            m = page.marks.up[m]
    content |= np.array([x.mark in whole for x in lines])
    return [x.text for x, keep in zip(lines, content, strict=True) if keep]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    open_tag = _OPEN_TAG.search(html, html.rfind(">") + 1)  # the page ends within it
    page.feed(html[: open_tag.start()] if open_tag else html)
    page.close()
    page.cut()
    return "\n".join(choose(page))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html); other columns are not looked at."""
    shared.prepare(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
