"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element is a line. The text lengths of neighbouring lines are summed over a
sliding window; where the sum surges above nothing a run of content begins, where it dives to nothing it ends. Lines of
menus, headers, footers, asides, notices, adverts, forms, scripts, styles and comments have no length, so they are the
valleys between the runs; where a page has an ``article`` or ``main`` element, it bounds the runs. Of several runs those
count that are about as heavy as the longest one or lie in the element that encloses it.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_column

# Fixed markup names.
BLOCKS = frozenset("address article blockquote body br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = re.compile(r"(?i)(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?:ads?|adsbygoogle|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|menu|navbar|nav|"
                   r"breadcrumbs?|sidebar|related|share|sharing|social|comment\w*|respond|replies|disqus|newsletter|subscribe|signup|footer)(?:$|[\s_-])")
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
WHITE = re.compile(r"\s+")
#: Names that layouts also give to text: an element of such a name is noise if its text is mostly links, or outside the main element.
LAYOUT = re.compile(r"(?i)(?:^|[\s_-])(?:header|masthead|widget|banner)(?:$|[\s_-])")
WINDOW = 3


class Named:
    """An element with a name of layouts: how much of its text is links?"""

    def __init__(self) -> None:
        self.chars = self.links = 0

    def add(self, text: str, links: int) -> None:
        self.chars, self.links = self.chars + len(text), self.links + links

    def noise(self) -> bool:
        return 2 * self.links >= self.chars


class Lines(HTMLParser):
    """``lines``: (text, is it possible content, its main element or 0, its enclosing elements, the named ones of them) of each block, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.path: list[int] = []
        self.named: list[Named | None] = []
        self.lines: list[tuple[str, bool, int, tuple[int, ...], tuple[Named, ...]]] = []
        self.parts: list[str] = []
        self.links = self.seen = self.mains = 0

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        links, self.parts, self.links = min(self.links, len(text)), [], 0
        if text:
            noise, main = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
            named = tuple(n for n in self.named if n)
            if not noise:
                for n in named:
                    n.add(text, links)
            self.lines.append((text, not noise, main, tuple(self.path), named))

    def shut(self, k: int) -> None:
        del self.open[k:], self.path[k:], self.named[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.shut(len(self.open) - 1)
        found = dict(attrs)
        inside = self.open[-1][2] if self.open else 0
        noise = (self.open[-1][1] if self.open else False) or tag in SKIPPED and not (tag == "header" and inside)
        marks = f"{found.get('class') or ''} {found.get('id') or ''}"
        whole = tag not in ("html", "body", "main") and not (tag == "article" and not inside)
        noise = noise or whole and bool(NOISE.search(marks)) or found.get("role") in NOISE_ROLES
        noise = noise or "hidden" in found or found.get("aria-hidden") == "true"
        self.seen += 1
        main = inside or (self.seen if tag in ("article", "main") or found.get("role") == "main" else 0)
        if main and not noise and not inside:
            self.mains += 1
        self.open.append((tag, noise, main))
        self.path.append(self.seen)
        self.named.append(Named() if whole and not noise and LAYOUT.search(marks) else None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.shut(k)
                return
            if self.open[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if any(tag == "a" for tag, *_ in self.open):
            self.links += len(WHITE.sub(" ", data))


def content_runs(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive points of the line-block distribution: (first line, line after the last) of each run.

    The block of line i is lines i to i + window - 1. A run begins at the first line with text of a block whose sum is
    above nothing; it ends where ``window`` lines in a row have no text.
    """
    runs, start, i, n = [], None, 0, len(lengths)
    sums = [sum(lengths[k:k + window]) for k in range(n)]
    while i < n:
        if start is None and lengths[i] and sums[i]:
            start = i
        elif start is not None and not sums[i]:
            runs.append((start, i))
            start = None
        i += 1
    if start is not None:
        runs.append((start, n))
    return runs


def content_lines(lengths: list[int], paths: list[tuple[int, ...]], mains: list[int]) -> list[int]:
    """The lines of the runs, but of one with less than a fifth of the longest run's text only those in the same container.

    The container is the main element that the longest run begins in (``mains``, 0 for none), else the deepest element that
    encloses the blocks of all its lines.
    """
    runs = content_runs(lengths)
    weight = [sum(lengths[a:b]) for a, b in runs]
    if not runs:
        return []
    a, b = runs[weight.index(max(weight))]
    around = [paths[i][:-1] for i in range(a, b) if lengths[i]]
    depth = next((k for k, ids in enumerate(zip(*around)) if len(set(ids)) > 1), min(map(len, around)))
    home = around[0][:depth]
    near = lambda i: mains[i] == mains[a] if mains[a] else paths[i][:depth] == home
    return [i for (a_, b_), w in zip(runs, weight, strict=True) for i in range(a_, b_) if lengths[i] and (5 * w >= max(weight) or near(i))]


def main_text(html: str | None) -> str:
    """Blocks of the content runs joined by one space. Character references are decoded, white space is one space.

    A page with an ``article`` or ``main`` element has its content there. A null or empty page has no text. Markup that
    is never closed reaches to the end of what encloses it. Names such as ``ad``, ``comments`` or ``notice`` mark noise
    however much text it has; those of ``LAYOUT`` do so outside the main element, and inside it where the text is mostly links.
    """
    if not html:
        return ""
    page = Lines()
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # the parser gives up on some broken declarations
        return WHITE.sub(" ", unescape(re.sub(r"<[^>]*>", " ", html))).strip()
    page.flush()
    lines = page.lines
    counts = [len(text) if content and (main or not page.mains) and not any(n.noise() if main else True for n in named) else 0
              for text, content, main, _, named in lines]
    kept = content_lines(counts, [path for *_, path, _ in lines], [main for _, _, main, _, _ in lines])
    return " ".join(lines[i][0] for i in kept)


def extracted(pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry``, text and n_chars (its code points).

    Every row is judged by its own page alone: repeated rows stay, pages are read whole however long, other columns are
    not read, and ``text`` and ``n_chars`` of the table give way.
    """
    inputs = pages.select(*carry, pages[html].alias("markup_in"))

    def texts(pages: list) -> list[tuple]:
        found = [main_text(p) for p in pages]
        return [(t, len(t)) for t in found]

    return map_column(inputs, "markup_in", "text string, n_chars long", texts, list(carry))


def op9(pages: DataFrame) -> DataFrame:
    return extracted(pages)
