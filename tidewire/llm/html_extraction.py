"""Main text of pages by the distribution of text over blocks of lines.

Markup is stripped: every block of a page becomes a line, and what is no article by its markup (menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, readers' comments) leaves blank
lines in its place. Lines weigh what they have of text outside links. Over windows of LINES lines the
weights are summed: a window sum that rises from nothing is a surge, one that falls back to nothing a dive, and
the text between them is kept if its highest window shows an article. Inside of a marked article every line
weighs at least SHORT, so that short paragraphs and headings never dive; entering and leaving it are dives.
In pages without such an element each container that ends or begins is a blank line, and of the runs between dives
those count that reach a share of the highest window.

Defined results: a null or empty page, and one without text outside its surroundings, has the text "". Broken
markup is read as far as it goes: an element that is never closed ends with its parent, a comment or script
without an end hides the rest, a tag without an end is dropped with the rest. Very long pages are read whole, in
time in proportion to their length; repeated rows give repeated results; a null id is passed on; an empty table gives
no rows. main_texts returns the page's id and address; extract_main returns every column, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import free_names, map_batches

#: Lines of a window, the weight of a short line of an article, the least window of an article elsewhere and
#: its share of the page's highest; when text outside counts for more than a marked article.
LINES, SHORT, LEAST_WINDOW, SHARE = 3, 40, 80, 0.25
OUTSIDE_TIMES, OUTSIDE_LEAST = 10, 500

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
ENDLESS = re.compile(r"&#[0-9]{8,};?|&#[xX][0-9A-Fa-f]{7,};?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist"}
PARAGRAPHS = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "figcaption", "caption", "summary", "legend", "hr", "pre", "option"}
CONTAINERS = {
    "html", "body", "article", "main", "section", "div", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "blockquote", "figure", "header", "details",
    "address", "center", "optgroup",
} | CHROME
BLOCKS = PARAGRAPHS | CONTAINERS
INLINE = {"b", "i", "em", "strong", "span", "font", "u", "small"}
#: Words of a class, id or role that mark what is no article; those of the second kind only where no word of an article stands beside them.
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle adslot sponsor sponsored promo promotion comment comments disqus replies respond sidebar sidebars widget"
    " cookie cookies consent gdpr newsletter subscribe popup modal overlay breadcrumb breadcrumbs navigation navbar menu menubar pagination pager share sharing social related"
    " recommended recommendations trending complementary contentinfo search login signup skip tooltip".split()
)
WEAK_MARKS = set("nav header footer banner masthead topbar toolbar notice notices alert copyright legal colophon toc".split())
ARTICLE_MARKS = set("article content post entry story body main text".split())


@dataclass
class Line:
    text: str
    weight: int  # characters outside links
    gap: int  # blank lines before it
    landmark: int  # number of the marked article that it stands in, 0 for none


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw else {}


def is_article(name: str, raw: str) -> bool:
    """Whether a start tag marks an article."""
    if name in ("article", "main") or not raw:
        return name in ("article", "main")
    of = attributes(raw)
    return of.get("itemprop") == "articleBody" or of.get("role") in ("article", "main")


def marked(of: dict[str, str]) -> bool:
    """Whether an element's attributes say that it is no article."""
    if "hidden" in of or of.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", of.get("style", "")):
        return True
    words = {w.lower() for key in ("class", "id", "role") for w in WORDS.findall(of.get(key, ""))}
    return bool(words & MARKS) or (bool(words & WEAK_MARKS) and not words & ARTICLE_MARKS)


def tags(html: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, name, kind, attributes) of everything between texts: start tags "<", end tags "/", and what is passed over ""."""
    out, at, n = [], 0, len(html)
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            out.append((start, at, "", "", ""))
        elif html[start + 1 : start + 2] in ("!", "?"):
            at = (html.find(">", start) + 1) or n
            out.append((start, at, "", "", ""))
        elif m := TAG.match(html, start) or LOOSE.match(html, start):
            name, at = m[2].lower(), m.end()
            if not m[1] and name in RAW:
                closer = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = closer.end() if closer else n
                out.append((start, at, "", "", ""))
            else:
                void = name in VOID or m[3].endswith("/")
                out.append((start, at, name, "/" if m[1] else "void" if void else "<", m[3]))
        elif html[start + 1 : start + 2].isalpha() or html[start + 1 : start + 2] == "/":  # a tag without an end
            out.append((start, n, "", "", ""))
            break
        else:
            at = start + 1
    return out


def ends_of(found: list[tuple[int, int, str, str, str]]) -> list[int]:
    """For each tag the number of the one that ends its element: its own end tag, or its parent's."""
    ends, open_, count = [len(found)] * len(found), [], Counter()
    for i, (_, _, name, kind, _) in enumerate(found):
        if kind == "<":
            open_.append(i)
            count[name] += 1
        elif kind == "/" and count[name]:
            while True:
                j = open_.pop()
                count[found[j][2]] -= 1
                ends[j] = i
                if found[j][2] == name:
                    break
    return ends


class Page:
    """Lines of a page. Elements are followed on a stack; what is no article is passed over."""

    def __init__(self, html: str):
        self.html, self.tags = html, tags(html)
        self.ends = ends_of(self.tags)
        self.lines: list[Line] = []
        self.mass: dict[int, int] = {}
        self.stack: list[tuple[str, int]] = []  # name, and the article before
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.weight, self.gap, self.landmark, self.count = 0, LINES, 0, 0
        # Where articles begin: an element around one is no advert, whatever its class says.
        self.starts = [i for i, (_, _, name, kind, raw) in enumerate(self.tags) if kind == "<" and is_article(name, raw)]
        self.read()

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if not self.open["a"]:
            self.weight += len(piece)

    def flush(self) -> None:
        """The block that ends here becomes a line."""
        raw = "".join(self.parts)
        decoded = entities.unescape(ENDLESS.sub("\ufffd", raw)) if "&" in raw else raw
        line = " ".join(decoded.split())
        if line:
            weight = min(self.weight, len(line))
            self.lines.append(Line(line, weight, self.gap, self.landmark))
            self.mass[self.landmark] = self.mass.get(self.landmark, 0) + weight
            self.gap = 0
        self.parts, self.weight = [], 0

    def passed_over(self, i: int) -> bool:
        """Whether the element that a tag starts is no article."""
        _, _, name, _, raw = self.tags[i]
        if name in CHROME or (name == "header" and not self.open["article"]):
            return True
        if not raw or name in ("html", "body", "main", "header") or not marked(attributes(raw)):
            return False
        at = bisect_right(self.starts, i)
        return name == "article" or at == len(self.starts) or self.starts[at] >= self.ends[i]

    def enter(self, name: str, raw: str) -> None:
        before = self.landmark
        if name in BLOCKS:
            self.flush()
            if name in CONTAINERS and not self.landmark:
                self.gap += 1
            if name in PARAGRAPHS and name not in ("td", "th"):  # an open paragraph ends where the next one begins
                while self.stack and self.stack[-1][0] in PARAGRAPHS | INLINE:
                    self.leave_one()
        if is_article(name, raw) and (not self.landmark or (name == "article" and not self.open["article"])):
            self.count += 1
            self.landmark, self.gap = self.count, LINES
        self.stack.append((name, before))
        self.open[name] += 1

    def leave_one(self) -> None:
        name, before = self.stack.pop()
        if name in BLOCKS:
            self.flush()
            if before != self.landmark:
                self.landmark, self.gap = before, LINES
            elif name in CONTAINERS and not self.landmark:
                self.gap += 1
        self.open[name] -= 1

    def leave(self, name: str) -> None:
        """An end tag: of the innermost element of its name; a stray one ends a block only."""
        if self.open[name]:
            while self.stack[-1][0] != name:
                self.leave_one()
            self.leave_one()
        elif name in BLOCKS:
            self.flush()

    def read(self) -> None:
        at = i = 0
        while i < len(self.tags):
            start, end, name, kind, raw = self.tags[i]
            if start > at:
                self.text(self.html[at:start])
            at, i = end, i + 1
            if kind == "/":
                self.leave(name)
            elif kind == "void":
                if name in BLOCKS:
                    self.flush()
                elif name == "br":
                    self.parts.append(" ")
            elif kind == "<" and not self.passed_over(i - 1):
                self.enter(name, raw)
            elif kind == "<":
                self.flush()
                self.gap = max(self.gap, LINES)
                i = self.ends[i - 1]  # its own end tag goes with it, its parent's does not
                if i == len(self.tags):
                    at = len(self.html)
                elif self.tags[i][2] == name:
                    at, i = self.tags[i][1], i + 1
                else:
                    at = self.tags[i][0]
        self.text(self.html[at:])
        self.flush()


def runs(weights: list[int], gaps: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window) of every stretch of lines over which no window sum is nothing."""
    places, at = [], 0
    for gap in gaps:
        at += gap
        places.append(at)
        at += 1
    out: list[tuple[int, int, int]] = []
    start = last = None
    low = total = high = 0
    for i, (w, p) in enumerate(zip(weights, places, strict=True)):
        if not w:
            continue
        if last is not None and p - last > LINES:  # a window of blank lines between them: a dive and a new surge
            out.append((start, last_line + 1, high))
            start = None
        if start is None:
            start, low, total, high = i, i, 0, 0
        total += w
        while places[low] <= p - LINES:
            total -= weights[low]
            low += 1
        high, last, last_line = max(high, total), p, i
    if start is not None:
        out.append((start, last_line + 1, high))
    return out


def main_text(html: str | None) -> str:
    """The lines between surges and dives, one a line."""
    if not html:
        return ""
    page = Page(html)
    lines = page.lines
    inside = {k: m for k, m in page.mass.items() if k}
    best = max(inside, key=lambda k: (inside[k], -k), default=0)
    if best:
        outside = sum(line.weight for line in lines if not line.landmark)
        if outside >= OUTSIDE_LEAST and outside >= OUTSIDE_TIMES * inside[best]:
            best = 0
    if best:
        weights = [max(line.weight, SHORT) if line.landmark == best else 0 for line in lines]
    else:
        weights = [line.weight if not line.landmark else 0 for line in lines]
    found = runs(weights, [line.gap for line in lines])
    if not best:
        highest = max((h for _, _, h in found), default=0)
        found = [r for r in found if r[2] == highest or r[2] >= max(LEAST_WINDOW, SHARE * highest)]
    return "\n".join(line.text for a, b, _ in found for line, w in zip(lines[a:b], weights[a:b], strict=True) if w or not best)


def extract_main(pages: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """All rows and columns, with the main text of their page; the new column gets a longer name where its own is taken. No shuffle."""
    (name,) = free_names(pages, out_col)
    rows = pages.withColumn(name, F.col(html_col).cast("string"))
    at = len(rows.columns) - 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(rows, run, rows.schema)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, address, text and its length in code points."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = extract_main(rows, out_col="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
