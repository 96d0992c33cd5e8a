"""Main text of web pages by site template removal.

Each page is read once into element subtrees. Subtrees of block elements are hashed with their host in two ways: by their
bytes, and by their shape (path of tags and classes from the root, tags and classes below, share of link text), which stays the same
where a menu, advert or footer changes its words from page to page. Spark counts both by the number of different articles they
come with, so copies of one page count once. Subtrees whose bytes recur on several pages of a host are its template and are
deleted; so are those whose shape recurs on half of them, if a page has little text of that shape or mostly links. All blocks of
one shape count together: an article cut into like blocks is no template.

What templates cannot know is settled after that: on hosts of few pages by tag, role and class, and where a page marks its article
the text is the article's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlayer.llm.common import discard, materialize

#: Different articles of a host that a subtree must come with to be template, at least; for a shape also as a share of its articles.
LEAST_PAGES = 5
SHARE = 0.5
#: Characters outside links that a page has of a template's shape, at most, on the average and over all its blocks of that shape.
POOR = 160
#: Template hashes that are broadcast (8 bytes each); above it they are joined.
BROADCAST = 1_000_000

# Element and class names with a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BOILER = frozenset("nav footer aside form script style noscript template iframe svg button select textarea object dialog menu head title canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr".split())
INLINE_STOP = BLOCK
CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OUTER = frozenset("html body main article".split())
MAIN = frozenset("main article".split())
#: Elements without text of the page, whatever a host's template.
MARKUP = frozenset("script style noscript template iframe svg head title canvas audio video object".split())
HASHED = frozenset("aside details div dl figure footer form h1 h2 h3 h4 h5 h6 header li nav ol p section table ul".split())
HASHED_WITHIN = frozenset("aside details div dl figure footer form header nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[^a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in RAW}


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(source)}


def _boiler(tag: str, found: dict[str, str], within: bool) -> bool:
    """Whether an element is no content by its tag, role, class, id or visibility."""
    if tag in BOILER or (tag == "header" and not within):
        return True
    if not found:
        return False
    words = set(_WORD.split(found.get("class", "") + " " + found.get("id", "")))
    if tag == "article":
        return bool(words & {"comment", "comments"})
    if tag in OUTER:
        return False
    return bool(words & CLASSES) or (not within and "header" in words) or found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


class Frame:
    """An open element: what it holds so far. ``shapes``: (shape, all links) of its block and link children in order."""

    __slots__ = ("tag", "start", "parts", "boiler", "within", "link", "label", "path", "shapes", "text", "linked", "main")

    def __init__(self, tag: str, start: int, boiler: bool, within: bool, link: bool, label: str, path: int) -> None:
        self.tag, self.start, self.boiler, self.within, self.link, self.label, self.path = tag, start, boiler, within, link, label, path
        self.parts: list = []
        self.shapes: list[tuple[int, bool]] = []
        self.text = self.linked = 0
        self.main = False

    def shape(self) -> int:
        """A hash of the element's structure; neighbours that are links only and alike count as one."""
        below, last = [], None
        for child in self.shapes:
            if child != last or not child[1]:
                below.append(child[0])
            last = child
        return _mix(f"{self.label} {4 * self.linked // max(self.text, 1)} {below}", 5)


def _mix(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


class Page:
    """One pass over a page. ``hashes`` and ``shapes``: template keys of its block subtrees; ``text``: what remains without ``templates``.

    ``rules``: also delete by tag, role and class; ``bound``: where an article is marked, its text only.
    """

    def __init__(self, source: str, host: str, templates=None, rules: bool = True, bound: bool = True) -> None:
        self.hashes: list[int] = []
        #: by key the characters and those in links, over all blocks of that shape
        self.shapes: dict[int, list[int]] = {}
        self.templates, self.source, self.prefix, self.rules, self.bound = templates, source, host.encode() + b"\0", rules, bound
        self.stack = [Frame("", 0, False, False, False, "", _mix(host, 4))]
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._end(tag, m.start(), at)
                continue
            self._start(tag, m[3] or m[6] or "", m.start())
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
        while len(self.stack) > 1:
            self._close(len(source))
        self.text = self._join(self.stack[0])

    def _text(self, s: str) -> None:
        top = self.stack[-1]
        if s and not top.boiler:
            s = html.unescape(s) if "&" in s else s
            top.parts.append(s)
            n = len(s.strip())
            top.text += n
            if top.link:
                top.linked += n

    def _start(self, tag: str, attributes: str, at: int) -> None:
        if tag in CLOSES_P:
            self._close_implied("p", at)
        elif tag == "li":
            self._close_implied("li", at, ("ul", "ol", "menu"))
        top = self.stack[-1]
        if tag in BLOCK or tag == "br":
            top.parts.append(" ")
        if tag in VOID:
            return
        found = _attributes(attributes)
        boiler = top.boiler or (_boiler(tag, found, top.within) if self.rules else tag in MARKUP)
        label, path = tag, top.path
        if tag in BLOCK:
            label = " ".join([tag, *sorted(found.get("class", "").split()), found.get("role", "")])
            path = _mix(f"{top.path} {label}", 4)
        self.stack.append(Frame(tag, at, boiler, top.within or tag in MAIN, top.link or tag == "a", label, path))

    def _close_implied(self, tag: str, at: int, scope: tuple = ()) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag:
                while len(self.stack) > k:
                    self._close(at)
                return
            if (name in scope) if scope else (name in INLINE_STOP):
                return

    def _end(self, tag: str, start: int, end: int) -> None:
        block = tag in BLOCK
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag:
                while len(self.stack) > k + 1:
                    self._close(start)
                self._close(end)
                return
            if (not block and name in INLINE_STOP) or (tag == "p" and name in CLOSES_P):
                return

    def _close(self, at: int) -> None:
        frame = self.stack.pop()
        top, tag = self.stack[-1], frame.tag
        if tag in BLOCK:
            top.parts.append(" ")
            shape = frame.shape()
            top.shapes.append((shape, frame.text == frame.linked > 0))
        elif tag == "a":
            top.shapes.append((1, True))
        else:
            top.shapes += frame.shapes
        inner, main = frame.within and tag not in MAIN, frame.main or tag in MAIN
        top.main |= main
        loose: list | Loose = frame.parts
        if not top.boiler and tag in (HASHED_WITHIN if inner else HASHED):
            key = xxhash.xxh64_intdigest(self.prefix + self.source[frame.start : at].encode("utf-8", "surrogatepass"), 9)
            self.hashes.append(key)
            if self.templates is not None and key in self.templates:
                return
            # an article's own paragraphs and containers may look alike on all pages: within it only links tell a template
            if tag in HASHED_WITHIN and not main and (not inner or 2 * frame.linked >= frame.text > 0):
                key = _mix(f"{frame.path} {shape}", 6)
                joint = self.shapes.setdefault(key, [0, 0])
                joint[0] += frame.text
                joint[1] += frame.linked
                if self.templates is not None and key in self.templates:
                    if inner:
                        return
                    loose = Loose(frame, key)
        top.text += frame.text
        top.linked += frame.linked
        if frame.boiler:
            return
        if tag in MAIN and not top.within and self.bound:
            top.parts.append((frame.parts,))
        else:
            top.parts.append(loose)

    def _join(self, root: Frame) -> str:
        """The parts in page order; only the articles' where there are any at the outer level.

        Subtrees of one template shape that together hold over half of the page's text are its content and stay.
        """
        out, articles = [], []
        queue: list[tuple] = [(root.parts, False)]
        while queue:
            part, inside = queue.pop()
            if isinstance(part, str):
                (articles if inside else out).append(part)
            elif isinstance(part, tuple):
                queue.append((part[0], True))
                articles.append(" ")
            elif isinstance(part, Loose):
                if 2 * self.shapes[part.key][0] > root.text:
                    queue.append((part.parts, inside))
            else:
                queue.extend((p, inside) for p in reversed(part))
        return " ".join("".join(articles or out).split())


class Loose:
    """A subtree of a template's shape, to be deleted unless it is the page's main text."""

    __slots__ = ("parts", "key")

    def __init__(self, frame: Frame, key: int) -> None:
        self.parts, self.key = frame.parts, key


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html", **how: bool) -> DataFrame:
    """``(page, host, article, key, shape, text, linked)``: a row for each block subtree and each of their shapes, and one with a null
    key for each page. ``text`` and ``linked``: the characters that the page has of a shape, and those of them in links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, host, article, key, shape, text = [], [], [], [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = _host(url)
                parsed = Page(source or "", name, **how)
                keys = [(None, False), *((k, False) for k in dict.fromkeys(parsed.hashes)), *((k, True) for k in parsed.shapes)]
                page += [xxhash.xxh64_intdigest(name.encode() + b"\0" + (source or "").encode("utf-8", "surrogatepass"), 3)] * len(keys)
                host += [xxhash.xxh64_intdigest(name.encode())] * len(keys)
                article += [xxhash.xxh64_intdigest(parsed.text.encode("utf-8", "surrogatepass"))] * len(keys)
                key += [k for k, _ in keys]
                shape += [x for _, x in keys]
                text += [parsed.shapes[k] if x else (0, 0) for k, x in keys]
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (page, host, article)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None if k is None else k - (1 << 64) if k >> 63 else k for k in key], pa.int64()), pa.array(shape, pa.bool_()), *(pa.array([x[i] for x in text], pa.int64()) for i in (0, 1))], names=["page", "host", "article", "key", "shape", "text", "linked"])

    return pages.select(F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).mapInArrow(run, "page long, host long, article long, key long, shape boolean, text long, linked long")


def templates(found: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """``(key, n)``: subtrees that come with enough different articles of their host, shapes also with a share of them and poor in text."""
    each = found.groupBy("host", "key", "shape", "article").agg(F.max("text").alias("text"), F.max("linked").alias("linked"))
    counted = each.groupBy("host", "key", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("text").alias("text"), F.sum("linked").alias("linked"))
    whole = counted.where("key is null").select("host", F.col("n").alias("pages"))
    frequent = counted.where(F.col("key").isNotNull() & (F.col("n") >= least_pages)).join(whole, "host")
    poor = (2 * F.col("linked") >= F.col("text")) | (F.col("text") - F.col("linked") <= POOR * F.col("n"))
    return frequent.where(~F.col("shape") | ((F.col("n") >= share * F.col("pages")) & poor)).select("key", "n")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, share: float = SHARE, rules: bool = True, bound: bool = True) -> DataFrame:
    """``(page_id, url, text)``, one row per input row.

    Null and empty pages have an empty text; null urls share one host without a name. Character references are
    decoded, each run of white space in the text becomes one space, blocks are joined by one space. Rows that repeat an
    id are read each for itself. A recurring subtree within an article is deleted whatever its length, its headings, paragraphs and
    list items never for themselves. Like blocks that hold the text of an article are no template. ``rules`` and ``bound`` switch off what follows the templates: deletion by tag, role and
    class, and the article's bound. An empty table gives an empty result.
    """
    how = {"rules": rules, "bound": bound}
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    found = materialize(subtrees(rows, **how), "subtrees")
    known = materialize(templates(found, least_pages, share), "templates")
    shared = None
    if known.count() <= BROADCAST:
        shared = rows.sparkSession.sparkContext.broadcast(frozenset(x.key % (1 << 64) for x in known.select("key").toLocalIterator()))
        discard(found)
        rows = rows.withColumn("keys", F.array().cast("array<long>"))
    else:
        hits = found.join(known, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))
        rows = _with_page(rows).join(hits, "page", "left").select("page_id", "url", "html", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, source, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known = shared.value if shared is not None else {k % (1 << 64) for k in keys or ()}
                out.append(Page(source or "", _host(url), known, **how).text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def _with_page(rows: DataFrame) -> DataFrame:
    """The rows with the page hash that :func:`subtrees` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = [xxhash.xxh64_intdigest(_host(u).encode() + b"\0" + (s or "").encode("utf-8", "surrogatepass"), 3) for u, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(page, np.uint64).view(np.int64))], names=["page_id", "url", "html", "page"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, html string, page long")
