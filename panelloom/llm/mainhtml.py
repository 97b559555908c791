"""Main text of web pages by text-to-tag ratios."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements that end a block, elements whose text is never main text, elements without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset(
    "aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object option search select "
    "style script svg template textarea title video audio map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class and id names, and roles, of parts beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social "
    "sidebar sidebars aside widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar comment comments commentlist discussion respond reply replies responses feedback disqus "
    "form login search toolbar pagination pager rail teaser teasers announcement copyright disclaimer skip hidden".split()
)
# Words of names that tell of a header, and those that make it the article's own.
HEADERS = frozenset("header branding logo".split())
OWN = frozenset("article content entry post story headline title".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KERNEL = [math.exp(-(d * d) / 2) for d in range(-3, 4)]  # Gaussian of one line's width


def beside(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a start tag names a part beside the article: by its own name, its role, its class or its id."""
    if tag in OUTSIDE:
        return True
    if tag in ("html", "body", "main"):
        return False
    for key, value in attributes:
        value = value or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip().lower() in ROLES:
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    # "has-sidebar" tells of the layout, not of the element.
    return any(not {"has", "no", "with", "without"} & words and not BESIDE.isdisjoint(words) for words in names(attributes))


def names(attributes: list[tuple[str, str | None]]) -> Iterator[set[str]]:
    """The words of each class and id name."""
    for key, value in attributes:
        if key in ("class", "id"):
            for name in (value or "").split():
                yield {w.lower() for w in NAME.findall(name)}


def heads_page(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a start tag names a header, by its own name, its class or its id."""
    return tag == "header" or any(not HEADERS.isdisjoint(words) and OWN.isdisjoint(words) for words in names(attributes))


class Line:
    """A block of text with what its selection needs."""

    __slots__ = ("text", "tags", "linked", "owner", "heading", "outside")

    def __init__(self, text: str, tags: int, linked: int, owner: int, heading: bool, outside: bool):
        self.text, self.tags, self.linked, self.owner, self.heading, self.outside = text, tags, linked, owner, heading, outside

    def ratio(self) -> float:
        """Text outside links for each tag, as a logarithm, since paragraphs differ by orders of magnitude."""
        return 0.0 if self.outside else math.log1p((len(self.text) - self.linked) / max(1, self.tags))


class Lines(HTMLParser):
    """Parser events to lines: a line ends where an element of BLOCKS starts or ends.

    Only elements of BLOCKS and OUTSIDE are held open, so unclosed inline tags cost nothing. An end tag closes
    the innermost element of its name; one that closes nothing is ignored.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.kinds = [-1], ["root"]  # of every element held so far
        self.stack: list[tuple[str, int, bool]] = [("root", 0, False)]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, owner, outside = self.stack[-1]
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), owner, self.kinds[owner] in ("h1", "h2", "h3", "h4", "h5", "h6"), outside))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag == "a":
            self.links = 1
        if tag in VOID:
            return
        off = beside(tag, attrs)
        # A header inside an article is its own.
        if not off and tag in ("header", "div", "section", "table") and not (self.open["article"] or self.open["main"]):
            off = heads_page(tag, attrs)
        if tag in BLOCKS or off:
            if tag in BLOCKS:
                while self.stack[-1][0] == "p" or tag == "li" and self.stack[-1][0] == "li":
                    self.open[self.stack.pop()[0]] -= 1
            _, above, outside = self.stack[-1]
            if tag not in BLOCKS:
                self.end_line()
            self.parents.append(above)
            self.kinds.append(tag)
            self.stack.append((tag, len(self.kinds) - 1, off or outside and tag != "main"))
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        # A slash at the end means nothing outside of void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = 0
        if tag in BLOCKS or self.open[tag]:
            self.end_line()
        self.tags += 1
        if self.open[tag]:
            while True:
                name, _, _ = self.stack.pop()
                self.open[name] -= 1
                if name == tag:
                    break

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        near = range(max(0, i - 3), min(len(values), i + 4))
        out.append(sum(values[j] * KERNEL[j - i + 3] for j in near) / sum(KERNEL[j - i + 3] for j in near))
    return out


def threshold(values: list[float]) -> float:
    """The value between the two clusters of the smoothed ratios, by two means."""
    low, high = min(values), max(values)
    while True:
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            return cut
        means = sum(below) / len(below), sum(above) / len(above)
        if abs(means[0] - low) + abs(means[1] - high) < 1e-9:
            return cut
        low, high = means


def region(page: Lines) -> tuple[list[Line], bool]:
    """The lines of the content region, and whether the page marks it.

    Lines whose smoothed ratio lies in the upper cluster vote with their length for the elements they stand
    in; where a page has article or main elements with text, only lines in these vote. The innermost element
    with at least two thirds of the votes is the region.
    """
    lines, parents, kinds = page.lines, page.parents, page.kinds
    marked = [False] * len(kinds)
    for i in range(1, len(kinds)):
        marked[i] = marked[parents[i]] or kinds[i] in ("article", "main")
    fit = [not x.outside for x in lines]
    named = [ok and marked[x.owner] for ok, x in zip(fit, lines)]
    voters = named if any(named) else fit
    if not any(voters):
        return [], False
    ratios = smoothed([x.ratio() if ok else 0.0 for ok, x in zip(voters, lines)])
    cut = threshold(ratios)
    content = [ok and r >= cut for ok, r in zip(voters, ratios)]
    if not any(content):
        content = voters
    votes = [0] * len(kinds)
    for ok, x in zip(content, lines):
        if ok:
            votes[x.owner] += len(x.text)
    for i in range(len(kinds) - 1, 0, -1):  # an element comes after its parent
        votes[parents[i]] += votes[i]
    holders = [i for i in range(len(kinds)) if 3 * votes[i] >= 2 * votes[0] and kinds[i] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote")]
    home = holders[-1]
    if any(named):  # the whole article, not a part of it
        while not (kinds[home] in ("article", "main") or home == 0):
            home = parents[home]
    inside = [False] * len(kinds)
    inside[home] = True
    for i in range(home + 1, len(kinds)):
        inside[i] = inside[parents[i]]
    picked = [k for k, x in enumerate(lines) if fit[k] and inside[x.owner]]
    if not any(named):
        # Without a mark the region begins and ends with content, but for headings before it and unlinked lines behind.
        first = next(n for n, k in enumerate(picked) if content[k])
        last = max(n for n, k in enumerate(picked) if content[k])
        while first and lines[picked[first - 1]].heading:
            first -= 1
        while last + 1 < len(picked) and kinds[lines[picked[last + 1]].owner] == "p" and not lines[picked[last + 1]].linked:
            last += 1
        picked = picked[first : last + 1]
    # Runs of lines that are links only, below the threshold, are lists of other pages.
    menu = [not content[k] and lines[k].linked >= 0.8 * len(lines[k].text) for k in picked]
    runs = [m and (n and menu[n - 1] or n + 1 < len(menu) and menu[n + 1]) for n, m in enumerate(menu)]
    return [lines[k] for k, run in zip(picked, runs) if not run], any(named)


def extract(html: str) -> str:
    """The main text of a page: its blocks in page order, joined by an empty line."""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    found, _ = region(page)
    return "\n\n".join(x.text for x in found)


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([extract(html.as_py() or "") for html in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` to one row per page: page_id, url, text, n_chars.

    Events of the standard library's parser cut a page into lines, one for each block. A line's ratio is its
    text outside links for each tag; the ratios are smoothed by a Gaussian and split in two clusters. The lines
    of the upper one select the element that is the content region, of which all lines stay, short ones too,
    but for runs of links. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    reader comments are known by their elements, roles, class and id names and count as no text. Character
    references are decoded, white space in a block is one space.

    Each page is read alone, whole, without a shuffle. Null and empty html, and pages without text, give an
    empty text; broken markup is read as far as it goes; null ids and URLs stay; repeated pages give repeated
    rows. No pages give no rows. Other columns are ignored.
    """
    given = pages.select("page_id", "url", "html")
    kinds = dict(given.dtypes)
    schema = f"page_id {kinds['page_id']}, url string, text string"
    out = given.withColumn("url", F.col("url").cast("string")).mapInArrow(extracted, schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
