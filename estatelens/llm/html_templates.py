"""Main text of web pages: what a site repeats is found by counting element subtrees per host.

Every element's subtree is hashed (tag, texts, children). A container whose hash stands on MIN_PAGES differing pages of
a host, however large the host is, and leaves OWN_SHARE of their main text beside it, is the site's template and is
deleted with all below it. Blocks of text (paragraphs, headings, lists, tables and the like) are templates only outside article
and main, and only at the same place of the tree: an article may say what other articles say. Elements that say by tag
or role that they are no content go in any case; those that only their class or id names so, and forms, go unless they
hold the article or half of the page's text. What is left of the article is the main text.

Defined results: a null or empty html has the text ''; pages without a host are a host of their own; pages of a host
with the same main text count once; a page of which templates would leave less than OWN_SHARE is a copy of what others
print, and keeps those of at least that share, or all if that is not enough; words, list items and parts of tables are no template by themselves, only within one;
repeated rows give repeated rows; an empty table gives no rows; extra columns do not matter. Broken mark-up never
fails: unclosed elements end with their parent, an unclosed tag at the end is no text. Work and memory are linear in
the page, nesting included.
"""

from __future__ import annotations

import html
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .toxicity import in_slices

ship(__name__)

MIN_PAGES = 3  # different pages of the host that hold the subtree
OWN_SHARE = 0.1  # of a page's main text that templates leave, or they stay
PART_BYTES = 1_000_000  # pages parsed at once, unless one is longer

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|xmp|noembed|noframes"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = frozenset(
    "head nav footer aside button select option input menu dialog canvas object audio video map "
    "script style noscript template textarea title iframe svg noembed noframes".split())
MAY_HOLD_ARTICLE = frozenset("form fieldset".split())  # no content, unless the article is inside
NO_CONTENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup paywall sidebar aside "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "widget footer masthead comment comments commentlist respond disqus replies toolbar skip login".split())
BESIDE_WORDS = frozenset(  # what may stand beside them in one name
    "box block wrapper wrap container area list bar section region zone slot unit panel link links icon icons button "
    "buttons item items top bottom left right inner outer site page global primary secondary main sticky fixed floating "
    "form feed row column content post posts article articles entry story user reader header group holder text".split())
CLOSED_BY = {  # an opening tag ends an open element of these, unless one of the second set stands between
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = ("html", "body", "main", "article")
NO_TEMPLATE = INLINE.union(ROOTS, "li dt dd td th tr thead tbody tfoot caption".split())  # not by themselves
TEXT_BLOCKS = HEADINGS.union("p blockquote pre ul ol dl table figure figcaption address details summary center".split())
HARD, SOFT = 1, 2  # no content in any case; unless the article is inside

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s>/]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _names_no_content(name: str) -> bool:
    """One class or id: all its words say so, or stand beside one that does."""
    words = _WORD.findall(name)
    return not NO_CONTENT_WORDS.isdisjoint(words) and all(w in NO_CONTENT_WORDS or w in BESIDE_WORDS for w in words)


def _no_content(tag: str, attributes: str) -> int:
    """HARD, SOFT or 0."""
    if tag in NO_CONTENT:
        return HARD
    soft = tag in MAY_HOLD_ARTICLE
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "role" and value in NO_CONTENT_ROLES:
            return HARD
        if name in ("class", "id") and tag not in ROOTS:
            soft = soft or any(map(_names_no_content, value.split()))
    return SOFT if soft else 0


class Page:
    """Texts of a page in order, and its elements as ranges of texts with subtree hashes."""

    def __init__(self, source: str):
        self.texts: list[str | None] = []  # None: a block begins or ends here
        self.elements: list[tuple[str, int, int, int | None, int]] = []  # tag, first text, end, template key, no content
        self._open: list[list] = []  # tag, first text, parts of the hash, no content, place, children, inside the article
        self._root = ["", 0, [], 0, 0, 0, False]
        self._read(source)

    def _close(self) -> None:
        tag, first, parts, gone, place, _, in_article = self._open.pop()
        if tag not in INLINE:
            self.texts.append(None)
        digest = xxhash.xxh64_intdigest(f"{tag}\x00" + "\x01".join(parts))
        if parts:
            key = None
            if tag in TEXT_BLOCKS:
                key = None if in_article else (digest ^ place) - (1 << 63)
            elif tag not in NO_TEMPLATE:
                key = digest - (1 << 63)
            self.elements.append((tag, first, len(self.texts), key, gone))
            if self._open:
                self._open[-1][2].append(str(digest))

    def _close_through(self, tags: set[str], bounds: set[str]) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth][0]
            if tag in tags:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in bounds:
                return

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text:
            self.texts.append(text)
            if (plain := " ".join(text.split())) and self._open:
                self._open[-1][2].append(plain)

    def _read(self, source: str) -> None:
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            if not (tag := m["tag"]):
                continue
            tag = tag.lower()
            if m["end"]:
                if any(x[0] == tag for x in reversed(self._open)):
                    while self._open[-1][0] != tag:
                        self._close()
                    self._close()
                continue
            if tag in VOID:
                if tag != "wbr":
                    self.texts.append(" " if tag in ("br", "img") else None)
                continue
            if tag in CLOSED_BY:
                self._close_through(*CLOSED_BY[tag])
            elif tag not in INLINE and self._open and (self._open[-1][0] == "p" or self._open[-1][0] in INLINE):
                self._close_paragraph()
            if tag not in INLINE:
                self.texts.append(None)
            self._begin(tag, _no_content(tag, m["attributes"]))
        if at < len(source):
            self._text(source[at:])
        while self._open:
            self._close()

    def _begin(self, tag: str, no_content: int) -> None:
        """Opens an element; its place is that of its parent, its number among the siblings and its tag."""
        parent = self._open[-1] if self._open else self._root
        place, number, in_article = parent[4], parent[5], parent[6] or parent[0] in ("article", "main")
        parent[5] += 1
        place = xxhash.xxh64_intdigest(f"{place}/{number}{tag}")
        self._open.append([tag, len(self.texts), [], no_content, place, 0, in_article])

    def _close_paragraph(self) -> None:
        """A block ends an open paragraph, and with it what is open inside."""
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth][0]
            if tag == "p":
                while len(self._open) > depth:
                    self._close()
            elif tag in INLINE:
                continue
            return

    def subtrees(self) -> tuple[dict[int, int], int]:
        """Key of each element that may be a template, with the characters of main text in it; those of the page."""
        kept, gone = self._kept(frozenset())
        able = sorted((first, -i, end, key) for i, (_, first, end, key, _) in enumerate(self.elements)
                      if key is not None and first < end and not gone[first])  # parents come before children
        before = self._chars_before(kept)
        return {key: before[end] - before[first] for first, _, end, key in able}, before[-1]

    def _chars_before(self, kept) -> list[int]:
        """Characters of the kept texts before each text, and of all at the end."""
        return list(itertools.accumulate(
            (len(t.strip()) if t and k else 0 for t, k in zip(self.texts, kept)), initial=0))

    def _kept(self, templates: frozenset[int]) -> tuple[bytearray, bytearray]:
        """Which texts are main text; which are in templates or elements of no content."""
        gone, keep, heading = (bytearray(len(self.texts) + 1) for _ in range(3))
        articles, mains, headers, soft = [], [], [], False
        for tag, first, end, key, no_content in reversed(self.elements):  # parents come before children
            if first < end and not gone[first]:
                if no_content == HARD:
                    gone[first:end] = b"\x01" * (end - first)
                soft = soft or no_content == SOFT
        before = self._chars_before(not g for g in gone) if soft else None
        roots = sorted(first for tag, first, end, *_ in self.elements if tag in ("article", "main")) if soft else []
        for tag, first, end, key, no_content in reversed(self.elements):
            if first == end or gone[first]:
                continue
            if no_content == SOFT and not (bisect_left(roots, first) < bisect_left(roots, end)
                                           or 2 * (before[end] - before[first]) > before[-1]):
                gone[first:end] = b"\x01" * (end - first)
            elif key is not None and key in templates:
                gone[first:end] = b"\x01" * (end - first)
            elif tag == "article":
                articles.append((first, end))
            elif tag == "main":
                mains.append((first, end))
            elif tag == "header":
                headers.append((first, end))
            elif tag in HEADINGS:
                heading[first:end] = b"\x01" * (end - first)
        for first, end in articles or mains or [(0, len(self.texts))]:
            if not keep[first]:  # else inside an outer one
                keep[first:end] = b"\x01" * (end - first)
        for first, end in headers:  # of headers only the headings of an article stay
            if not gone[first]:
                for i in range(first, end):
                    gone[i] |= not (articles and heading[i])
        return bytearray(k and not g for k, g in zip(keep, gone)), gone

    def text(self, templates: frozenset[int]) -> str:
        """The main text without templates and elements of no content; blocks joined by line ends."""
        kept, _ = self._kept(templates)
        if templates:
            found, total = self.subtrees()
            small = frozenset(k for k in templates if found.get(k, 0) < OWN_SHARE * total)
            for spared in (small, frozenset()):
                if self._chars_before(kept)[-1] < OWN_SHARE * total:
                    kept, _ = self._kept(spared)
        blocks, run = [], []
        for i, text in enumerate([*self.texts, None]):
            if text is None:
                if run:
                    if block := " ".join("".join(run).split()):
                        blocks.append(block)
                    run = []
            elif kept[i]:
                run.append(text)
        return "\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, PART_BYTES, "html"):
        copies, totals, found = [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            chars, total = page.subtrees()
            copies.append(xxhash.xxh64_intdigest(page.text(frozenset())) - (1 << 63))
            totals.append(total)
            found.append([{"subtree": h, "chars": n} for h, n in chars.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("page"), pa.array(copies, pa.int64()), pa.array(totals, pa.int64()),
             pa.array(found, pa.list_(pa.struct([("subtree", pa.int64()), ("chars", pa.int64())])))],
            names=["host", "page", "copy", "total", "found"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, PART_BYTES, "html"):
        templates = [frozenset(t or ()) for t in batch.column("_templates").to_pylist()]
        texts = [Page(s or "").text(t) for s, t in zip(batch.column("html").to_pylist(), templates)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_key() -> Column:
    """The host as a number, which is what is counted and joined."""
    return F.xxhash64(host_of(F.col("url")))


def page_key() -> Column:
    """The page as a number; rows that are equal throughout share it."""
    return F.xxhash64("page_id", "url", "html")


def repeated(rows: DataFrame) -> DataFrame:
    """host and subtree of those on MIN_PAGES differing pages: distinct first, which spreads a hot host, then per subtree."""
    return rows.select("host", "copy", "subtree").distinct().groupBy("host", "subtree").agg(
        F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "subtree")


def site_templates(pages: DataFrame) -> DataFrame:
    """One row per page (host and page as hashes) that has templates: their hashes.

    Templates are joined with the pages' own subtrees, so no list is longer than a page.
    """
    found = stored(pages.select(host_key().alias("host"), page_key().alias("page"), "html").mapInArrow(
        _subtrees, "host bigint, page bigint, copy bigint, total bigint, found array<struct<subtree bigint, chars bigint>>"))
    rows = found.select("host", "page", "copy", "total", F.explode("found").alias("f")).select(
        "host", "page", "copy", "total", "f.*")
    part = rows.where(F.col("total") - F.col("chars") >= OWN_SHARE * F.col("total"))
    return rows.select("host", "page", "subtree").distinct().join(
        repeated(part), ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("_templates"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; each page meets its own templates."""
    keyed = pages.select("page_id", "url", "html", host_key().alias("host"), page_key().alias("page"))
    found = site_templates(pages).hint("merge")  # few pages go the way of many, so figures of small inputs carry over
    joined = keyed.join(found, ["host", "page"], "left").select("page_id", "url", "html", "_templates")
    return joined.mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
