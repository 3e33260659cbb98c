"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and a clustering threshold.

Parser events are turned into lines: the text between two block-level tags, with the number of tags
in it, its link text and the containers it stands in. Scripts, styles, forms and the elements and
marks of navigation, notices, adverts and comments are closed to text. The text-to-tag ratios of the
lines in page order are smoothed with a Gaussian and split into two clusters (1-D 2-means); the
lines of the high cluster select the content regions. An article or main element that holds
such a line is a region; where none does, it is the innermost container of all such lines, or if that is
the whole page, the innermost container of each. A region is kept whole, so that titles and short
paragraphs are not lost, and so are short lines between two regions that are not links.

The parser keeps stacks of positions, so that its time follows the length of the page.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import slices

#: elements that never hold main text; fixed values
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea option label input iframe svg canvas object dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: containers that a region can be
BOXES = frozenset("address article aside body details div fieldset footer form header html main nav section".split())
#: opening one of these ends an open paragraph
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: words of class, id and role that mark what is not main text; fixed values
MARKS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr menu modal nav navbar navigation newsletter pagination popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe subscription".split())
#: these mark it too, but not inside an article, where they are parts of it; fixed values
OUTER = frozenset("banner footer header masthead notice search toolbar widget".split())
#: what may follow a mark in a compound like "cookie-box"; other words make it something else ("search-engine-history"); fixed values
PARTS = frozenset("area bar block box buttons container content form inner item items label link links list panel placeholder posts section slot thread top unit wrap wrapper".split())
SEPARATORS = re.compile(r"[-_]+")
SPACE = re.compile(r"\s+")


def marked(names: str, inside: bool) -> bool:
    """Whether one of the names marks what is not main text: a mark alone, at the end of a compound, or before parts only."""
    known = MARKS if inside else MARKS | OUTER
    for name in names.lower().split():
        words = [w.rstrip("0123456789") for w in SEPARATORS.split(name)]
        while len(words) > 1 and (words[-1] in PARTS or not words[-1]):
            words.pop()
        if words[-1] in known:
            return True
    return False


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: int
    boxes: tuple | None  # (number, parent): the containers from the innermost out
    article: int  # the number of the outermost article or main element, or 0


class Events(HTMLParser):
    """Collects the lines of a page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.buffer = [], [], []
        self.tags = self.links = self.closed = self.articles = self.article = self.numbers = self.anchors = 0
        self.places: dict[str, list[int]] = {}  # positions in ``open`` by tag
        self.block_places: list[int] = []
        self.lists: list[int] = []
        self.box = None

    def flush(self):
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), self.box, self.article))
        self.buffer, self.tags, self.links = [], 0, 0

    def _pop(self):
        tag, skipped, box, article = self.open.pop()
        self.places[tag].pop()
        if tag in BLOCKS:
            self.block_places.pop()
        if tag in ("ul", "ol"):
            self.lists.pop()
        self.anchors -= tag == "a"
        self.closed -= skipped
        self.box = box
        self.articles -= article
        if not self.articles:
            self.article = 0

    def _last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def _pop_to(self, at: int):
        while len(self.open) > at:
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        p = self._last("p")
        if tag in ENDS_P and p >= 0 and self.block_places[-1] == p:
            self._pop_to(p)
        if tag == "li" and self._last("li") > (self.lists[-1] if self.lists else -1):
            self._pop_to(self._last("li"))
        a = {k: v or "" for k, v in attrs}
        role, inside = a.get("role", "").lower(), self.articles > 0
        article = tag in ("article", "main") or role in ("main", "article")
        is_marked = tag not in ("html", "body", "main") and marked(f"{a.get('class', '')} {a.get('id', '')}", inside)
        part = inside and tag == "header" and not is_marked  # an article's own header holds its title
        skipped = (tag in SKIPPED and not part) or is_marked or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu") or "hidden" in a or a.get("aria-hidden") == "true"
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.block_places.append(len(self.open))
        if tag in ("ul", "ol"):
            self.lists.append(len(self.open))
        self.anchors += tag == "a"
        self.open.append((tag, int(skipped), self.box, int(article)))
        self.closed += skipped
        self.articles += article
        self.numbers += 1
        if tag in BOXES:
            self.box = (self.numbers, self.box, tag)
        if article and self.articles == 1:
            self.article = self.numbers

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        at = self._last(tag)
        if at >= 0 and (tag in BLOCKS or tag in SKIPPED or not self.block_places or self.block_places[-1] <= at):
            self._pop_to(at)

    def handle_data(self, data):
        if not self.closed:
            self.buffer.append(data)
            if self.anchors:
                self.links += len(data)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML has no self-closing form of other tags than void ones


def smoothed(x: list[float], sigma: float = 1.0) -> list[float]:
    r = max(1, math.ceil(2 * sigma))
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - r), min(len(x), i + r + 1)
        w = k[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(x[lo:hi], w, strict=True)) / sum(w))
    return out


def two_means(x: list[float]) -> float:
    """The threshold between the two clusters of the values."""
    lo, hi = min(x), max(x)
    for _ in range(50):
        mid = (lo + hi) / 2
        a, b = [v for v in x if v < mid], [v for v in x if v >= mid]
        if not a or not b:
            break
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def high_lines(lines: list[Line], sigma: float = 1.0) -> list[bool]:
    """Which lines are of the high cluster of smoothed text-to-tag ratios, or reach its threshold by themselves.

    A line that is only lifted by its neighbours must itself have a quarter of the threshold.
    """
    own = [len(x.text) / max(1, x.tags) for x in lines]
    ratio = smoothed(own, sigma)
    cut = two_means(ratio)
    return [o >= cut or (r >= cut and 4 * o >= cut) for r, o in zip(ratio, own, strict=True)]


def _common(boxes: list) -> tuple | None:
    """The innermost container that holds all of these; a container's number is larger than those around it."""
    deepest = boxes[0]
    for box in boxes[1:]:
        while deepest is not None and box is not None and deepest[0] != box[0]:
            if deepest[0] > box[0]:
                deepest = deepest[1]
            else:
                box = box[1]
        if box is None:
            return None
    return deepest


def regions(lines: list[Line], sigma: float = 1.0, select=high_lines) -> list[str]:
    """The texts of the lines of the content regions; ``select`` tells which lines choose them."""
    if not lines:
        return []
    high = [x for x, h in zip(lines, select(lines, sigma), strict=True) if h] or lines
    high = [x for x in high if 2 * x.links < len(x.text)] or high  # what is mostly links chooses no region
    articles = {x.article for x in high if x.article}
    if articles:
        return [x.text for x in lines if x.article in articles]
    common = _common([x.boxes for x in high])
    chosen = {common[0]} if common is not None and common[2] not in ("html", "body") else {x.boxes[0] if x.boxes else 0 for x in high}
    whole = {0, *(x.boxes[0] for x in high if x.boxes and x.boxes[2] in ("html", "body"))}
    known: dict = {}

    def inside(box) -> bool:
        """Whether the container is chosen or stands in a chosen one (the page itself counts only for what is directly in it)."""
        path = []
        while box is not None and box[0] not in known:
            if box[0] in chosen:
                known[box[0]] = True
                break
            path.append(box[0])
            box = box[1]
            if box is not None and box[0] in whole:
                box = None
        found = box is not None and known[box[0]]
        known.update(dict.fromkeys(path, found))
        return found

    keep = [(x.boxes is None and 0 in chosen) or inside(x.boxes) for x in lines]
    places = [i for i, k in enumerate(keep) if k]
    for i in range(places[0], places[-1] + 1):  # short lines between regions, if they are not links
        keep[i] = keep[i] or 2 * lines[i].links < len(lines[i].text)
    return [x.text for x, k in zip(lines, keep, strict=True) if k]


def main_text(html: str, select=high_lines) -> str:
    p = Events()
    p.feed(html)
    p.close()
    p.flush()
    return "\n".join(regions(p.lines, select=select))


def _extract(batches):
    import pyarrow as pa

    for rows, texts in slices(batches, "html"):
        out = [main_text(t.decode("utf-8", "replace")) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null, empty or broken pages have the text that can be read, else ''. Pages of any length are
    parsed whole, in time that follows their length. Repeated rows give repeated rows; an empty
    table gives none. Only page_id, url and html are read, whatever other columns there are.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
