"""Rows of list pages and posts with comments, from HTML.

A page is read once by a tokenizer of tags that keeps a stack of open elements: void elements have no end, an end tag closes everything
down to the element it names (one that names none is passed over), items, rows, cells and paragraphs end where the
next one of their list, table or parent begins, and what is open at the end of the page ends there. Scripts, styles and comments are no
text. Elements are kept as places in the page, so none of it is copied.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_BLANK = re.compile(r"[ \t\r\n\f\v\u00a0]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset({"script", "style", "textarea", "title"})
INLINE = frozenset("a abbr b code em font i mark small span strong sub sup u".split())
#: An element that begins ends an open one of the second kind, unless an open one of the third is in between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "article", "td", "li", "section", "body"}), "option": ({"option"}, {"select"})}
COMMENTS = 10


def unescaped(text: str) -> str:
    """`text` with its entities as signs; one without its semicolon, as where a text was cut off, stays as it is."""
    return _ENTITY.sub(lambda m: entities.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


@dataclass
class Element:
    tag: str
    attributes: str
    depth: int
    begin: int  # places in `Page.parts`
    end: int = -1
    _read: dict[str, str] | None = field(default=None, repr=False)

    @property
    def named(self) -> dict[str, str]:
        if self._read is None:
            self._read = {m[1].lower(): unescaped(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)}
        return self._read

    def has_class(self, name: str) -> bool:
        return name in self.named.get("class", "")


class Page:
    """Elements of a page in order, and the pieces of text between its tags."""

    def __init__(self, html: str):
        self.elements: list[Element] = []
        self.parts: list[str] = []
        stack: list[Element] = []
        self._open: Counter[str] = Counter()
        at, raw = 0, None
        for m in _TAG.finditer(html):
            if raw is not None and not (m[1] and m[2] and m[2].lower() == raw):
                continue  # a tag inside a script or title is its text
            if m.start() > at and raw not in ("script", "style"):
                self.parts.append(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag not in INLINE:
                self.parts.append(" ")
            if m[1]:
                raw = None
                self._close(stack, tag)
                continue
            if tag in ENDS:
                self._end_like(stack, *ENDS[tag])
            now = Element(tag, m[3] or "", len(stack), len(self.parts))
            self.elements.append(now)
            if tag in VOID or (m[3] or "").rstrip().endswith("/"):
                now.end = now.begin
            else:
                stack.append(now)
                self._open[tag] += 1
                raw = tag if tag in RAW else None
        if raw not in ("script", "style"):
            self.parts.append(html[at:])
        for e in stack:
            e.end = len(self.parts)

    def _drop(self, stack: list[Element], k: int) -> None:
        """End the elements from the kth open one on."""
        for e in stack[k:]:
            e.end = len(self.parts)
            self._open[e.tag] -= 1
        del stack[k:]

    def _close(self, stack: list[Element], tag: str) -> None:
        if self._open[tag]:
            self._drop(stack, next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))

    def _end_like(self, stack: list[Element], ended: set[str], within: set[str]) -> None:
        while any(self._open[t] for t in ended):
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in ended or stack[k].tag in within)
            if stack[k].tag in within:
                return
            self._drop(stack, k)

    def text(self, e: Element) -> str:
        return _BLANK.sub(" ", unescaped("".join(self.parts[e.begin : e.end]))).strip(" ")

    def inside(self, e: Element) -> Iterator[Element]:
        """The elements within `e`, in order."""
        for k in range(self._index(e) + 1, len(self.elements)):
            if self.elements[k].depth <= e.depth:
                return
            yield self.elements[k]

    def _index(self, e: Element) -> int:
        if not hasattr(self, "_places"):
            self._places = {id(x): k for k, x in enumerate(self.elements)}
        return self._places[id(e)]


def number(text: str) -> int:
    """Counts like 1,234, 1.2k or 1.2万; 0 for anything else."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([k千万]?)", text.replace(",", "").strip().lower())
    return int(float(m[1]) * {"": 1, "k": 1000, "千": 1000, "万": 10_000}[m[2]]) if m else 0


def absolute(link: str, base: str) -> str:
    parts = urlsplit(base if "//" in base else f"https://{base}")
    root = f"{parts.scheme}://{parts.netloc}"
    if link.startswith("//"):
        return "https:" + link
    if not parts.netloc:
        return link
    if link.startswith("/"):
        return root + link
    return link if link.startswith("http") else f"{root}/{link}"


def list_rows(html: str, url: str) -> Iterator[tuple[int, str, str, str, str, int, int]]:
    """(row, title, link, author, time, reads, comments) of the rows of a list page: table rows of the class listitem, else those with a
    cell l1, else list items. A row without a titled link is passed over."""
    page = Page(html)
    rows = [e for e in page.elements if e.tag == "tr" and e.has_class("listitem")]
    rows = rows or [e for e in page.elements if e.tag == "tr" and any(x.tag == "td" and x.named.get("class") == "l1" for x in page.inside(e))]
    rows = rows or [e for e in page.elements if e.tag == "li"]
    n = 0
    for row in rows:
        within = list(page.inside(row))
        cell = lambda name: next((e for e in within if e.named.get("class") == name), None)  # noqa: E731, B023
        said = lambda name: page.text(e) if (e := cell(name)) else ""
        titled = cell("title")
        link = next((e for e in (page.inside(titled) if titled else within) if e.tag == "a" and e.named.get("href")), None)
        title = page.text(link) if link else ""
        if title:
            n += 1
            author = cell("author")
            name = next((page.text(e) for e in page.inside(author) if e.tag == "a"), "") if author else ""
            yield n, title, absolute(link.named["href"].strip(), url), name, said("update"), number(said("read")), number(said("reply"))


def post(html: str) -> tuple[str, str, str, list[tuple[str, str, int]]]:
    """(pattern, title, content, comments) of a post: the first of four content elements that is there, and (author, text, likes) of its first
    ten comments."""
    page = Page(html)
    patterns = (("post_content", lambda e: e.named.get("id") == "post_content"), ("stockcodec", lambda e: e.has_class("stockcodec")), ("article-body", lambda e: e.has_class("article-body")), ("article", lambda e: e.tag == "article"))
    found = next(((name, e) for name, fits in patterns for e in page.elements if fits(e)), None)
    title = next((page.text(e) for e in page.elements if e.tag == "h1"), "")
    comments = []
    for block in [e for e in page.elements if e.has_class("reply-item")][:COMMENTS]:
        within = list(page.inside(block))
        said = next((e for e in within if e.has_class("reply-text")), None) or next((e for e in within if e.tag == "div" and e.has_class("text")), None)
        content = page.text(said) if said else ""
        if content:
            author = next((page.text(e) for e in within if e.tag == "a" and e.has_class("user-name")), "")
            likes = next((page.text(e) for e in within if e.tag == "span" and e.has_class("like-count")), "")
            comments.append((author, content, number(likes)))
    return found[0] if found else "", title, page.text(found[1]) if found else "", comments


def _stream(df: DataFrame, f, schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    kind = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html"))) for row in f(i, url or "", html or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found) if found else [()] * len(fields), fields)], schema=kind)

    return df.select("id", "url", "html").mapInArrow(run, schema)


def rows_of_lists(pages: DataFrame) -> DataFrame:
    """The rows of `pages` (id, url, html), one each."""
    names = [("id", pa.int64()), ("row", pa.int32()), ("title", pa.string()), ("link", pa.string()), ("author", pa.string()), ("time", pa.string()), ("reads", pa.int64()), ("comments", pa.int64())]
    return _stream(pages, lambda i, url, html: ((i, *r) for r in list_rows(html, url)), "id long, row int, title string, link string, author string, time string, reads long, comments long", names)


def posts_of(pages: DataFrame) -> DataFrame:
    """pattern, title, content and number of comments of each of `pages`."""

    def read(i: int, url: str, html: str):
        pattern, title, content, comments = post(html)
        yield i, pattern, title, content, len(comments)

    names = [("id", pa.int64()), ("pattern", pa.string()), ("title", pa.string()), ("content", pa.string()), ("comments", pa.int64())]
    return _stream(pages, read, "id long, pattern string, title string, content string, comments long", names)


def comments_of(pages: DataFrame) -> DataFrame:
    """The first ten comments of each of `pages`, one row each."""
    names = [("id", pa.int64()), ("place", pa.int32()), ("author", pa.string()), ("content", pa.string()), ("likes", pa.int64())]
    return _stream(pages, lambda i, url, html: ((i, n, *c) for n, c in enumerate(post(html)[3], 1)), "id long, place int, author string, content string, likes long", names)
