"""Main text of web pages: site templates removed by counting subtrees per host.

Each container element is hashed as it is and as a shape: its element, class
and id with those of its children, text masked, repeated children counted
once. Both are counted per host. An element is a template if it recurs as it
is on the host's pages, or if its shape does and its very content is found on
other pages of the table too (adverts that rotate). The second rule never
touches the elements that hold most of the text of the host's pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.common import OWN, texts_of, with_fields
from geonear.session import materialize

#: A subtree is a template if it recurs on this share of its host's pages, and
#: on this many of them at least. Pages with the same article count once.
MIN_SHARE = 0.3
MIN_PAGES = 5
#: Elements at a place that holds more than this of the text of a host's pages, on average, are its content.
CONTENT_SHARE = 0.5
#: What is counted: pages, subtrees of a host, shapes of a host, places of a host, subtrees anywhere.
_PAGE, _SUBTREE, _SHAPE, _PLACE, _ANYWHERE = range(5)

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset(
    "aside details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
NOT_TEXT = frozenset(
    "aside button canvas dialog footer form head header iframe math menu nav noembed noframes noscript object "
    "script search select style svg template textarea title xmp".split())
#: What a start tag closes if it is still open, and the elements such a search never leaves.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of a class, id or role that mark what isn't the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices notification popup promo related replies reply respond share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget widgets".split())

_SKIP = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_P_STAYS = CONTAINERS | {"article", "main", "body", "td", "th", "li", "blockquote", "button"}
_WORDS = re.compile(r"[^a-z0-9]+")


def _digest(*parts: bytes) -> bytes:
    return xxhash.xxh128_digest(b"\0".join(parts))


def _attributes(source: str) -> dict[str, str]:
    """Names in lower case and values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(source):
        found.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    return found


class _Open:
    """An element whose end is still to come."""

    __slots__ = ("name", "number", "out", "listed", "article", "main", "holds", "content", "place", "mark",
                 "source", "shapes", "chars")

    def __init__(self, name="", number=0, parent=None):
        self.name, self.number = name, number
        self.out = parent is not None and parent.out  # no text at all
        self.listed = parent is not None and parent.listed  # no article by the lists
        self.article = parent is not None and parent.article
        self.main = parent is not None and parent.main
        self.content = parent is not None and parent.content
        self.holds = False  # an article
        self.place = self.mark = b""
        self.source, self.shapes, self.chars = None, set(), 0


class _Page:
    """One pass over a page's tags.

    ``subtrees`` gets ``(element number, subtree, shape, place, characters)``
    of every container that isn't dropped by its element; ``text`` the blocks
    of the main text. Time is linear in the page: digests of an element are
    made from those of its children.
    """

    def __init__(self, html: str, removed=frozenset(), shaped=frozenset(), content=frozenset(),
                 lists: bool = True, digests: bool = False):
        self.html, self.removed, self.shaped, self.content = html, removed, shaped, content
        self.lists, self.digests = lists, digests
        self.subtrees: list[tuple[int, bytes, bytes, bytes, int, bool]] = []
        # One list of blocks per kind of root: article, main, anything.
        self.blocks: tuple[list[str], ...] = ([], [], [])
        self.roots = [False, False]
        self.parts: list[str] = []
        self.inside = (False, False)  # whether they lie in the article, in main
        self.open = [_Open()]
        self.held: dict[str, int] = {}  # open elements by name
        self.walk()

    def text(self) -> str:
        kind = 2 if not self.lists else 0 if self.roots[0] else 1 if self.roots[1] else 2
        return "\n".join(self.blocks[kind])

    def flush(self) -> None:
        if self.parts:
            block = " ".join("".join(self.parts).split())
            self.parts = []
            # What is open by now may be dropped; the parts are not.
            if block:
                self.blocks[2].append(block)
                if self.inside[1]:
                    self.blocks[1].append(block)
                if self.inside[0]:
                    self.blocks[0].append(block)

    def close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        while len(self.open) > depth:
            e = self.open.pop()
            parent = self.open[-1]
            self.held[e.name] -= 1
            if e.name in BLOCKS:
                self.flush()
            parent.holds |= e.holds
            if self.digests and not e.out:
                shape = _digest(e.mark, *sorted(e.shapes))
                subtree = e.source.digest()
                if e.name in CONTAINERS or e.name in ("article", "main"):
                    self.subtrees.append((e.number, subtree, shape, e.place, e.chars, e.holds))
                if parent.source is not None:
                    parent.source.update(subtree)
                parent.shapes.add(shape)
                parent.chars += e.chars

    def close_named(self, names, stop=()) -> None:
        if not any(self.held.get(n) for n in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth].name
            if name in names:
                return self.close(depth)
            if name in stop:
                return

    def start(self, name: str, source: str, number: int) -> None:
        if name in BLOCKS:
            self.flush()
            self.close_named({"p"}, _P_STAYS)
            if name in CLOSES:
                self.close_named(*CLOSES[name])
        parent = self.open[-1]
        if name in VOID:
            if name == "br":
                self.parts.append(" ")
            if self.digests and parent.source is not None:
                parent.source.update(f"<{name} {source}>".encode("utf-8", "surrogatepass"))
            return
        e = _Open(name, number, parent)
        attributes = _attributes(source) if source and not e.out else {}
        e.content |= number in self.content
        e.out |= name in NOT_TEXT or number in self.removed or number in self.shaped and not e.content
        main, article = name == "main" or attributes.get("role", "").lower() == "main", name == "article"
        if attributes and not e.out and name not in ("html", "body"):
            e.out |= "hidden" in attributes
            words: set[str] = set()
            for key in ("class", "id", "role"):
                value = attributes.get(key, "").lower()
                # In the article only whole names count: a heading may be of class "section-header".
                words.update(value.split() if parent.article else _WORDS.split(value))
            if article or main:
                words &= {"comment", "comments"}
            e.listed |= not MARKED.isdisjoint(words)
        dropped = e.out or e.listed
        if not dropped:
            self.roots[0] |= article
            self.roots[1] |= main
        e.article |= article and not dropped
        e.main |= main and not dropped
        e.holds = article or main
        if self.digests and not e.out:
            e.mark = f"{name} {attributes.get('class', '')} {attributes.get('id', '')}".encode("utf-8", "surrogatepass")
            e.place = _digest(parent.place, e.mark)
            e.source = xxhash.xxh3_128(f"<{name} {' '.join(source.split())}>".encode("utf-8", "surrogatepass"))
        self.open.append(e)
        self.held[name] = self.held.get(name, 0) + 1

    def walk(self) -> None:
        html, at, number = self.html, 0, 0
        while True:
            begin = html.find("<", at)
            if begin < 0:
                self.data(html[at:])
                break
            match = _SKIP.match(html, begin)
            if match:
                self.data(html[at:begin])
                at = match.end()
                continue
            if not (html[begin + 1:begin + 2] == "/" or html[begin + 1:begin + 2].isascii() and html[begin + 1:begin + 2].isalpha()):
                self.data(html[at:begin + 1])
                at = begin + 1
                continue
            self.data(html[at:begin])
            # A tag whose quotes don't close ends at the next >, or else with the page.
            match = _TAG.match(html, begin) or _LOOSE.match(html, begin)
            if not match:
                end = html.find(">", begin)
                if end < 0:
                    break
                at = end + 1  # "</" before anything but a name is a comment
                continue
            at = match.end()
            name = match[2].lower()
            if match[1]:
                if name in BLOCKS:
                    self.flush()
                self.close_named((name,))
                continue
            number += 1
            self.start(name, match[3], number)
            if name in RAW:  # no tags inside
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = stop.start() if stop else len(html)
        self.close(1)
        self.flush()

    def data(self, text: str) -> None:
        top = self.open[-1]
        if not text or top.out:
            return
        if self.digests:
            plain = " ".join(text.split())
            top.chars += len(plain)
            if top.source is not None:
                top.source.update(plain.encode("utf-8", "surrogatepass"))
        if not self.lists or not top.listed:
            self.inside = (top.article, top.main)
            self.parts.append(unescape(text) if "&" in text else text)


def main_text(html: str, removed=frozenset(), shaped=frozenset(), content=frozenset(), lists: bool = True) -> str:
    """The article's blocks, one per line.

    ``removed`` are numbers of elements left out, ``shaped`` of those left out
    unless one of ``content`` holds them. A page without an article gives its
    main element, or else all its text, without what ``NOT_TEXT`` and
    ``MARKED`` name. Without ``lists`` neither the article nor ``MARKED`` counts.
    """
    return _Page(html, removed, shaped, content, lists).text()


def host_of(url: Column) -> Column:
    """Lower-case host of an address; pages without one form a host of their own."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def _page_key(host: Column, html: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(host).cast("string"), F.lit(":"), host, html)))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hosts = batch.column("key").to_pylist(), batch.column("host").to_pylist()
        rows: list[tuple] = []
        for key, host, html in zip(keys, hosts, texts_of(batch, "html")):
            page = _Page(html, digests=True)
            content = _digest(page.text().encode("utf-8", "surrogatepass"))
            rows.append((key, host, content, None, _PAGE, None, None))
            at_place: dict[bytes, int] = {}
            for _, _, _, place, chars, _ in page.subtrees:
                at_place[place] = at_place.get(place, 0) + chars
            whole = max(page.open[0].chars, 1)
            for number, subtree, shape, place, _, article in page.subtrees:
                rows.append((key, host, content, number, _PLACE, place, min(at_place[place] / whole, 1.0)))
                if not article:
                    rows += ((key, host, content, number, _SUBTREE, subtree, None),
                             (key, host, content, number, _SHAPE, shape, None),
                             (key, "", content, number, _ANYWHERE, subtree, None))
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["key", "host", "content", "number", "kind", "digest", "share"])


def template_elements(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                      min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``key, numbers, shaped, content``: the elements of each page that are templates of its host.

    ``key`` is the digest of a page's host and source; pages with the same
    main text count once, so copies of a page don't turn its text into a
    template. ``numbers`` recur as they are. ``shaped`` recur by their shape,
    and their very content is found on ``min_pages`` pages of any host;
    ``content`` are the elements at places that hold most of the text of the
    host's pages. An element that holds an article is never a template.

    Pages are parsed once; what was found is stored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = host_of(F.col(url_col))
    found = pages.select(_page_key(host, html).alias("key"), host.alias("host"), html.alias("html")).mapInArrow(
        _subtrees, "key binary, host string, content binary, number int, kind int, digest binary, share double")
    found = materialize(found, "subtrees")
    held = found.groupBy("host", "kind", "digest", "content").agg(F.max("share").alias("share")).groupBy(
        "host", "kind", "digest").agg(F.count("*").alias("pages"), F.sum("share").alias("share"))
    total = held.where(F.col("kind") == _PAGE).select("host", F.col("pages").alias("total"))
    often = F.col("pages") >= min_pages
    per_host = held.where(often & F.col("kind").isin(_SUBTREE, _SHAPE, _PLACE)).join(total, "host").where(
        F.when(F.col("kind") == _PLACE, F.col("share") > CONTENT_SHARE * F.col("total"))
        .otherwise(F.col("pages") > min_share * F.col("total")))
    names = ["host", "kind", "digest"]
    common = per_host.select(*names).unionAll(held.where(often & (F.col("kind") == _ANYWHERE)).select(*names))
    numbers_of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("number")))
    return (
        found.where(F.col("kind") != _PAGE).join(common, names).groupBy("key").agg(
            numbers_of(_SUBTREE).alias("numbers"),
            F.array_intersect(numbers_of(_SHAPE), numbers_of(_ANYWHERE)).alias("shaped"),
            numbers_of(_PLACE).alias("content"))
        .where((F.size("numbers") > 0) | (F.size("shaped") > 0))
    )


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text",
                 min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES, lists: bool = True) -> DataFrame:
    """``pages`` with the main text of each page in ``out_col``.

    Template elements of the page's host go first, then what is no article by
    its element or its class, id or role; without ``lists`` counting decides
    alone, beside the elements that are never text. Character references are
    decoded, white space inside a block becomes one space, and blocks are
    joined by line ends in page order. A null or empty page gives an empty
    text. Rows and other columns stay; a column named ``out_col`` is replaced.

    The elements to remove are written once: while they are few, Spark sends
    them to the pages rather than the pages to them.
    """
    sets = ("numbers", "shaped", "content")
    removed = materialize(template_elements(pages, url_col, html_col, min_share, min_pages), "templates")
    removed = removed.withColumnsRenamed({c: f"{OWN}{c}" for c in ("key", *sets)})
    base = pages.drop(out_col)
    keyed = base.withColumn(f"{OWN}key", _page_key(host_of(F.col(url_col)), F.coalesce(F.col(html_col), F.lit(""))))
    met = keyed.join(removed, f"{OWN}key", "left").drop(f"{OWN}key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*([set(v or ()) for v in batch.column(f"{OWN}{c}").to_pylist()] for c in sets))
            texts = [main_text(h, *f, lists=lists) for h, f in zip(texts_of(batch, html_col), found)]
            kept = [n for n in batch.schema.names if n not in {f"{OWN}{c}" for c in sets}]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, out_col])

    return met.mapInArrow(extract, with_fields(base, **{out_col: T.StringType()}))
