"""Main text of HTML pages from a stream of parser events.

Method. The standard library's parser streams events; block-level tags and line breaks end
a line. Each line has its text, the number of tags met on it, the containers around it and
whether one of these is marked as boilerplate by its tag, role, class or id. A line's text-to-tag
ratio is its characters over its tags (text inside links does not count); a mark lowers it to
nothing. Ratios are smoothed by a Gaussian kernel, marked runs apart from the rest, and split
into two clusters at the threshold where the two cluster means (1-D two-means) meet; lines
above it are content, on every page (outside articles, only lines that are not mostly links).
The content region follows from these lines: if one is in an article, the page's articles and
the containers outside them that hold such lines; else the innermost container that holds all
such lines, but for parts of it without one that are mostly links. Within the region what is
above the threshold counts, and so does what has no mark, so that short paragraphs stay.

Boilerplate. Elements for menus, scripts, controls, graphics and the like never count, and
their tags end no line, so that words on both sides of an icon stay together. Block elements
count as boilerplate by the last telling word of one of their class names, ids or labels
(``site-header`` and ``header-inner`` are headers; ``related-work``, ``no-sidebar``, ``entry-header``
and ``content-sidebar-wrap`` are not boilerplate). Within an article, ids and paragraphs are not marked by words that a
text may be about (``id=discussion``), and paragraphs of its own footer stay. On a page without article and main, the only h1 is
the headline, though it stands in a header. An inline element goes only as an advert or if it is hidden. A form goes
with its text, unless that is as much as all other text of the page: then the form is just
the frame of the page or of the article.

White space within a line becomes one space; lines are joined by one space. Memory is that
of one page.

Defined results: null and empty html, and pages without content, give an empty text;
broken markup is read as far as the parser's own rules go; repeated rows give equal
results; columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.shared import pieces

# Names of HTML elements, and words that mark boilerplate in roles, classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
HOLDS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol section table td ul".split())
SKIPPED = frozenset("applet audio canvas datalist iframe label map noscript object optgroup option script select style svg template textarea title video".split())
NEVER = SKIPPED | frozenset("button dialog fieldset head legend menu nav".split())
HEAD_HOLDS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adsbygoogle outbrain promo promos promoted promotion sponsor sponsored sponsors taboola".split())
MARKS = ADVERTS | frozenset(
    "alert alerts aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright cta disclaimer discussion disqus donate feedback footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup rail recommend recommended recommendations related replies reply respond responses search share sharing sidebar sidebars signup skip social subscribe subscription tagcloud tags teaser teasers toc toolbar topbar widget widgets".split()
)
#: Words of class names that say nothing of an element's kind.
GENERIC = frozenset(
    "area articles author bar block body bottom box button buttons col column columns container content count feed fixed form group head heading icon icons inner item items js label left line link links list media meta message module mobile outer panel placeholder post posts primary right row secondary section sections slot small sticky stories stripe strip text thread title top trail unit widget wrap wrapper zone".split()
)
#: In a class these tell that the element is next to something, or lacks it, and not that it is one.
BESIDE = frozenset("has hide is no non not with without".split())
#: Boilerplate that readers write or that has articles of its own: an article inside it is not the page's.
KEEPS_ARTICLES = frozenset("aside comment comments commentlist discussion disqus feedback replies reply respond responses related recommend recommended recommendations sidebar sidebars teaser teasers".split())
#: Words that ids of sections and classes of paragraphs have for what the text is about.
PROSE = frozenset("discussion feedback related replies reply respond responses search teaser teasers".split())
#: Classes that begin with these are of the article's own parts.
OWN, OWN_PARTS = frozenset("article entry post story".split()), frozenset("header teaser".split())
#: A wrapper whose class names these beside something else holds the content, too.
WRAPS, CONTENT = frozenset("container inner outer wrap wrapper".split()), frozenset("article content entry main page story".split())
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[a-z]+")
SIGMA = 1.5
#: Stands for the container of a headline that a page's header holds.
HEADLINE = -1


def mark(name: str) -> str | None:
    """The word of MARKS that a class name, id or label stands for, if any: the last one that tells."""
    words = [w for w in LETTERS.findall(HUMP.sub("-", name).lower()) if len(w) > 1]
    if not words or words[0] in BESIDE:
        return None
    wraps = words[-1] in WRAPS
    while len(words) > 1 and words[-1] in GENERIC:
        words.pop()
    if wraps and CONTENT & set(words[:-1]) or words[0] in OWN and words[-1] in OWN_PARTS and len(words) > 1:
        return None
    return words[-1] if words[-1] in MARKS else None


class Lines(HTMLParser):
    """Collects a page's lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, number of the container, of the article, of the form, whether boilerplate, whether text and line ends are passed over
        self.stack: list[tuple[str, int, int, int, bool, bool]] = []
        self.number, self.link = 0, 0
        self.parent = {0: 0}
        self.text: list[str] = []
        self.linked = self.tags = 0
        self.out: list[tuple[str, int, int, int, int, int, bool]] = []  # text, linked characters, tags, container, article, form, boilerplate
        self.within: tuple[int, int, int, bool, bool] = (0, 0, 0, False, False)
        self.plain: set[int] = set()  # headers and footers that no name marks
        self.headlines: list[tuple[int, bool]] = []  # lines of h1, and whether such a header holds them
        self.has_main = False

    def _end_line(self) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.out.append((t, self.linked, max(1, self.tags), *self.within[:4]))
            self.tags = 0
        self.text, self.linked = [], 0

    def _set(self) -> None:
        self.within = self.stack[-1][1:] if self.stack else (0, 0, 0, False, False)

    def _marks(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool]:
        """Whether the element is boilerplate, and whether of a kind that holds articles of its own. inside: within an article or main."""
        if tag in NEVER:
            return True, False
        bad, keeps = tag in ("aside", "footer") or tag == "header" and not inside, tag == "aside"
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                bad = True
            elif name == "style" and re.search(r"display:none|visibility:hidden", value.replace(" ", "").lower()):
                bad = True
            elif name in ("class", "id", "aria-label") and tag not in HEADINGS and tag not in ("html", "body", "main") and not (name != "class" and tag == "article"):
                found = {mark(x) for x in value.split()} - {None}
                if inside:
                    found -= {"header", "tags"}
                    if name == "id" or tag == "p":
                        found -= PROSE
                if tag not in BLOCK:
                    found &= ADVERTS
                bad = bad or bool(found)
                keeps = keeps or bool(found & KEEPS_ARTICLES)
        return bad, keeps

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_HOLDS:
            self.stack.pop()  # a head that was never closed
            self._set()
        if tag in BLOCK and not self.within[4]:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.link += 1
        if tag == "body" and self.stack:
            self.stack.clear()
        while self.stack and self.stack[-1][0] in ("p", "li", "dt", "dd") and tag in BLOCK and tag not in ("ul", "ol", "dl"):
            self.stack.pop()
        container, article, form, bad, skipped = self.stack[-1][1:] if self.stack else (0, 0, 0, False, False)
        own, keeps = self._marks(tag, attrs, bool(article) or any(s[0] == "main" for s in self.stack))
        if tag in ("article", "main") and bad and not own and not skipped and (tag == "main" or not any(s[0] == "#keeps" for s in self.stack)):
            bad = False  # a menu or advert that was never closed
        self.has_main = self.has_main or tag in ("article", "main")
        foot = tag == "p" and bool(article) and bool(self.stack) and self.stack[-1][0] == "footer" and container in self.plain and not own and not self.bad_above()
        if tag in HOLDS or own or foot:
            self.number += 1
            self.parent[self.number] = container
            bad = bad and not foot
            if tag in ("header", "footer") and own and not bad and not self._marks("div", attrs, bool(article))[0]:
                self.plain.add(self.number)
            if tag == "article" and not (bad or own) and not article:
                article = self.number
            if tag == "form" and not form:
                form = self.number
            skipped = skipped or tag in SKIPPED or own and tag not in BLOCK
            self.stack.append((tag, self.number, article, form, bad or own, skipped))
            if keeps:
                self.stack.append(("#keeps", self.number, article, form, True, skipped))
        self._set()

    def bad_above(self) -> bool:
        """Whether something marks the innermost element from further out."""
        return len(self.stack) > 1 and self.stack[-2][4]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self.within[4]:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if tag in BLOCK and not (self.within[4] and (at is None or self.stack[at][5])):
            before = len(self.out)
            self._end_line()
            if tag == "h1" and len(self.out) > before:
                self.headlines.append((before, self.within[0] in self.plain))
        self.tags += 1
        if tag == "a":
            self.link = max(0, self.link - 1)
        if at is not None:
            del self.stack[at:]
        self._set()

    def handle_data(self, data: str) -> None:
        if self.within[4]:
            return
        self.text.append(data)
        if self.link:
            self.linked += len(data.strip())

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # a comment that is never closed goes on to the end
        super().close()
        self._end_line()


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends only the weights that are on the page count."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    side = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return side(ratio) / side(np.ones(len(ratio)))


def threshold(x: np.ndarray) -> float:
    """Where two clusters of numbers part: halfway between the means of a settled two-means. The least positive number, if the means are within a factor of two: one cluster."""
    lo, hi = float(x.min()), float(x.max())
    if lo == hi:
        return lo
    for _ in range(50):
        cut = (lo + hi) / 2
        new = float(x[x <= cut].mean()), float(x[x > cut].mean()) if (x > cut).any() else hi
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2 if hi > 2 * lo else float(x[x > 0].min())


def region(parent: dict[int, int], above: list[int]) -> int:
    """The innermost container that holds all containers of a list."""
    path, at = [], above[0]
    while at:
        path.append(at)
        at = parent[at]
    path.append(0)
    depth = {c: i for i, c in enumerate(path)}
    lowest = 0
    for c in set(above):
        while c not in depth:
            c = parent[c]
        lowest = max(lowest, depth[c])
    return path[lowest]


def ratios(lines: list[tuple], good: np.ndarray) -> np.ndarray:
    """Smoothed text-to-tag ratios: nothing for marked lines, which are smoothed in runs of their own and lend nothing to others."""
    raw = np.array([max(0, len(x[0]) - x[1]) / x[2] if ok else 0.0 for x, ok in zip(lines, good, strict=True)])
    out = np.zeros(len(raw))
    out[good] = smooth(raw[good])
    for run in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(good.astype(int))) + 1):
        if len(run) and not good[run[0]]:
            out[run] = smooth(raw[run])
    return out


def main_text(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.close()
    # a form's text is content only if it is as long as all other text
    size: Counter = Counter()
    for text, _, _, _, _, form, bad in page.out:
        if not bad:
            size[form] += len(text)
    if not page.has_main and len(page.headlines) == 1 and page.headlines[0][1]:
        at = page.headlines[0][0]
        page.out[at] = (*page.out[at][:3], HEADLINE, *page.out[at][4:6], False)
    lines = [x for x in page.out if not (x[5] and size[x[5]] * 2 < size.total())]
    good = np.array([not x[6] for x in lines], bool)
    if not good.any():
        return ""
    ratio = ratios(lines, good)
    cut = threshold(ratio)
    high = list(ratio >= cut if ratio.any() else good)
    above = [x for x, h in zip(lines, high, strict=True) if h and x[3] != HEADLINE and (x[4] or 2 * x[1] <= len(x[0]))]
    if not above:
        return ""
    regions, articles = {x[3] for x in above}, set()
    if any(x[4] for x in above):
        articles = {x[4] for x, h in zip(lines, good, strict=True) if h and x[4]}
    else:
        top = region(page.parent, [x[3] for x in above])
        linked: Counter = Counter()
        for x, ok in zip(lines, good, strict=True):
            if ok and x[3] != HEADLINE:
                linked[x[3]] += 2 * x[1] - len(x[0])
        inside: dict[int, bool] = {}

        def within(c: int) -> bool:
            if c not in inside:
                inside[c] = c == top or c != 0 and within(page.parent[c])
            return inside[c]

        regions |= {x[3] for x in lines if x[3] != HEADLINE and linked[x[3]] <= 0 and within(x[3])}
    return " ".join(x[0] for x, ok, h in zip(lines, good, high, strict=True) if (ok or h) and (x[3] in regions or x[4] in articles or x[3] == HEADLINE))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, html_col):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
