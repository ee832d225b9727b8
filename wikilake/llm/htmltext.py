"""Main text of web pages, by equivalence classes of tokens across the pages of a host.

A token is an element's place in the page: the chain of the elements around it, with their classes and ids (long
numbers apart), and the number among its kind of a part that has neither.  Tokens of a host that share an occurrence vector (how often each page has them) are
a class.  A class that many pages have, with its tokens in the same order on every page, is valid; the
tokens of valid classes that a page has once nest by place into the host's template.  What stands
between them are the slots.  From the root the template is followed down to the part that holds the most text,
links not counted, as long as that is half of what its parent holds: this is the slot of the article.  Text in it
that is the template's own (blocks of a place and a text which share an occurrence vector, over distinct
articles, and make up a valid class) goes, too.

Names decide where the template leaves a choice: on the way down an <article> or <main> is kept whole, parts whose
names, roles or classes say that they are menus, headers, footers, sidebars, notices, adverts,
forms or comments are not counted and left out, and an only <h1> before the slot belongs to it.  A host of fewer than
MIN_PAGES pages has no template; its pages give their <article>, else <main>, else body, without such parts.
If the template's own text took more than half of an article, it is a near copy, not a template: then only places
that are the template's altogether go, or nothing.

Vectors are compared by their hashes and classes found by aggregation, so the pages of a
host never meet in one task; what meets is the tree of places that half of the pages have.  A null page has an empty
text, a null URL counts as a host of its own.  A page of any length is read whole.  Broken
markup is read as far as it makes sense: unclosed elements end with what holds them.  Ties of text between two parts
go to the smaller hash.  Repeated rows get equal texts, one row each, and count once; rows with a null page_id too.
An empty table gives no rows.  Other columns pass through; one named text is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikilake.llm.common import attach, only, saved, small, table, tidy

#: A token is frequent with this share of its host's pages, and this many.
MIN_SHARE, MIN_PAGES = 0.5, 3
# Element names of HTML and words in classes, ids and roles.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object audio video canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_AWAY = frozenset("head nav footer aside form button select dialog menu fieldset input header".split())
_AWAY_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer bottombar sidebar sidenav aside rail notice alert cookie cookies consent gdpr banner popup modal overlay toast ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted form search login signup subscribe subscription newsletter comment comments commentlist disqus replies breadcrumb breadcrumbs pagination pager related recommended share sharing social widget toolbar skip copyright contentinfo complementary".split()
)
# Words that put even an <article> away, and words by which a "header" is an article's own heading.
_NEVER = frozenset("comment comments commentlist disqus replies related recommended ad ads advert sponsored promo promoted".split())
_HEADINGS, _OWN = frozenset("header masthead banner".split()), frozenset("post article entry title content story".split())
_TOKEN = (1 << 62) - 1
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([A-Za-z_:@][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile("[0-9]{3,}")
#: Elements that are told apart by their number among their kind, where they have neither class nor id.
_COUNTED = frozenset("div section table tbody tr td center".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")




class Block(NamedTuple):
    """A block of text: the places of the elements around it, outermost first; rank: 2 in an article, 1 in another main
    part, else 0; whether its element is to be left out; whether it is an <h1>; characters in links; its text."""

    path: tuple[int, ...]
    rank: int
    away: bool
    h1: bool
    linked: int
    text: str


class Element(NamedTuple):
    """An element as it opens: its place and its parent's, its rank, and the number of blocks before it."""

    place: int
    parent: int
    rank: int
    at: int


@lru_cache(maxsize=1 << 14)
def _read(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, away, marks a main part) of an element."""
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attributes)} if attributes.strip(" /") else {}
    label = _DIGITS.sub("0", f"{name}.{found.get('class', '')}#{found.get('id', '')}")
    words = set(_WORD.findall(_CAMEL.sub(" ", " ".join(found.get(k, "") for k in ("class", "id", "role"))).lower()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    away = words & _AWAY_WORDS
    main = (name in ("article", "main") or found.get("role") in ("main", "article")) and not words & _NEVER
    if words & _OWN:
        away -= _HEADINGS
    return label, hidden or name in _AWAY or (bool(away) and not main and name not in ("body", "html")), main


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks and the elements of a page, in order."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, tuple[int, ...], int, bool, dict[str, int]]] = [("", (0,), 0, False, {})]  # name, path, rank, away, children without names
    parts: list[str] = []
    at, n, links, linked = 0, len(page), 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                name, path, rank, away, _ = stack[-1]
                out.append(Block(path, rank, away, name == "h1", min(linked, len(text)), text))
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) * (links > 0)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            links -= name == "a" and links > 0
            if any(e[0] == name for e in stack):
                if name not in _INLINE or stack[-1][0] == name:
                    if name not in _INLINE or stack[-1][3] != stack[-2][3]:
                        flush()
                    while stack[-1][0] != name:
                        stack.pop()
                    stack.pop()
            elif name == "p":
                flush()
            continue
        if name in _RAW:
            if not attributes.endswith("/"):
                end_tag = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end_tag.end() if end_tag else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        label, away, main = _read(name, attributes)
        links += name == "a"
        _, path, rank, gone, _ = stack[-1]
        if name in _INLINE:
            if away and not gone:
                flush()
                stack.append((name, (*path, crc32(label.encode(), path[-1])), rank, True, {}))
            continue
        flush()
        while stack[-1][0] == "p":
            stack.pop()
        closes = _CLOSED_BY.get(name)
        while closes and stack[-1][0] in closes:
            stack.pop()
        _, path, rank, gone, children = stack[-1]
        if name in _COUNTED and label.endswith(".#"):
            children[name] = children.get(name, 0) + 1
            label += str(children[name])
        if main:
            rank = max(rank, 2 if name == "article" else 1)
        if name == "header" and rank:
            away = False  # an article's own heading
        place = crc32(label.encode(), path[-1]) or 1
        elements.append(Element(place, path[-1], rank, len(out)))
        stack.append((name, (*path, place), rank, gone or away, {}))
    flush()
    return out, elements


def slot(blocks: list[Block], main: int | None) -> list[Block]:
    """The blocks of a page's slot for the article, below the place that the template gives; without one, or on a page
    that doesn't have it, of all of the page."""
    inside = [b for b in blocks if not b.away and main in b.path] if main is not None else []
    inside = inside or [b for b in blocks if not b.away]
    size = sum(len(b.text) for b in inside)
    for rank in (2, 1):  # an article in the slot, unless it is only a part of it
        own = [b for b in inside if b.rank >= rank]
        if own and (main is None or 2 * sum(len(b.text) for b in own) >= size):
            inside = own
            break
    titles = [b for b in blocks if b.h1 and not b.away]
    if len(titles) == 1 and inside and not any(b.h1 for b in inside) and next(b for b in blocks if b is titles[0] or b is inside[0]) is titles[0]:
        inside = [titles[0], *inside]
    return inside


def _token(place: int, text: str) -> int:
    """Negative, as places are not."""
    return -1 - (((place << 31) ^ crc32(text.encode("utf-8", "surrogatepass"))) & _TOKEN)


def main_text(blocks: list[Block], main: int | None, known: frozenset[int]) -> str:
    """The text of a page's slot, without what is the template's own: known has tokens, and places."""
    inside = slot(blocks, main)
    kept = [b.text for b in inside if _token(b.path[-1], b.text) not in known]
    if 2 * sum(map(len, kept)) < sum(len(b.text) for b in inside):
        kept = [b.text for b in inside if b.path[-1] not in known] or [b.text for b in inside]
    return "\n".join(kept)


def host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each page, the root among them: how often, where first, and the characters of text in them, without
    links and parts to leave out."""
    names = ["host", "page", "place", "parent", "rank", "n", "pos", "chars"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    for batch in batches:
        rows = []
        for site, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            blocks, elements = parsed(text or "")
            chars: dict[int, int] = {}
            for b in blocks:
                if not b.away:
                    for place in set(b.path):
                        chars[place] = chars.get(place, 0) + len(b.text) - b.linked
            found = {0: [0, 0, 1, -1]}
            for k, e in enumerate(elements):
                found.setdefault(e.place, [e.parent, e.rank, 0, k])[2] += 1
            rows += [(site, page, place, parent, rank, n, pos, chars.get(place, 0)) for place, (parent, rank, n, pos) in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def chosen(nodes: list[dict]) -> int | None:
    """The place of the article's slot among a host's frequent places (place, parent, rank, ok: of a valid class and once a page,
    mass: characters of all pages); None if there is no template below the root."""
    known = {x["place"]: x for x in nodes}
    below: dict[int, list[dict]] = {}
    for x in nodes:
        if x["ok"] and x["place"]:
            p = x["parent"]
            while p and not (p in known and known[p]["ok"]):
                p = known[p]["parent"] if p in known else 0
            below.setdefault(p, []).append(x)
    at, way = 0, []
    while at in below:
        best = max(below[at], key=lambda x: (x["mass"], -x["place"]))
        if 2 * best["mass"] < known[at]["mass"] or not best["mass"]:
            break
        at = best["place"]
        way.append(best)
    if not way:
        return None
    top = max(x["rank"] for x in way)
    if top:  # kept whole
        return next(x["place"] for x in way if x["rank"] == top)
    marked, open_ = [], list(below.get(at, ()))
    while open_:
        x = open_.pop()
        open_ += below.get(x["place"], ())
        if x["rank"] and 4 * x["mass"] >= way[-1]["mass"]:
            marked.append(x)
    return max(marked, key=lambda x: (x["rank"], x["mass"], -x["place"]))["place"] if marked else at


def _valid(rows: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """frequent (host, key, vector) with valid: all pages have the tokens of the class in one order.  rows: host, page, key, pos."""
    frequent = small(frequent)
    order = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("pos", key))), lambda x: x[key]))
    orders = rows.join(frequent.select("host", key, "vector"), ["host", key]).groupBy("host", "vector", "page").agg(order.alias("order"))
    valid = orders.groupBy("host", "vector").agg((F.min("order") == F.max("order")).alias("valid"))
    return frequent.join(valid, ["host", "vector"])


def _vector() -> Column:
    return F.bit_xor(F.xxhash64("page", "n")).alias("vector")


def _enough() -> Column:
    return (F.col("support") >= MIN_PAGES) & (F.col("support") >= MIN_SHARE * F.col("pages"))


def template(pages: DataFrame) -> DataFrame:
    """(host, main): the place of the article's slot in the template of each host of pages (url, html) that has one."""
    pages = pages.select(host("url").alias("host"), F.xxhash64("url", "html").alias("page"), "html")
    rows = pages.mapInArrow(tidy(_places), "host string, page long, place long, parent long, rank int, n int, pos int, chars long")
    rows = saved(rows.dropDuplicates(["host", "page", "place"]))
    totals = rows.where("place = 0").groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.groupBy("host", "place").agg(_vector(), F.count("*").alias("support"), F.max("n").alias("most"), F.sum("chars").alias("mass"), F.min("parent").alias("parent"), F.max("rank").alias("rank"))
    frequent = saved(counts.join(small(saved(totals)), "host").where(_enough()))
    valid = _valid(rows, frequent, "place")
    # At most 1 / MIN_SHARE times the places of a mean page stand in a host's tree.
    trees = valid.groupBy("host").agg(F.collect_list(F.struct("place", "parent", "rank", "mass", (F.col("valid") & (F.col("most") == 1)).alias("ok"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([chosen(x) for x in batch.column("nodes").to_pylist()], pa.int64())], ["host", "main"])

    return trees.mapInArrow(tidy(run), "host string, main long").where("main is not null")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the slots of pages, under a key of the article: a place and a text, how often and where first; a row with
    n = 0 stands for the whole."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    for batch in batches:
        rows = []
        for site, main, text in zip(*(batch.column(c).to_pylist() for c in ("host", "main", "html")), strict=True):
            inside = [(b.path[-1], b.text) for b in slot(parsed(text or "")[0], main)]
            own = int.from_bytes(blake2b(repr(inside).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            seen: dict[tuple[int, int], list[int]] = {}
            for pos, (place, block) in enumerate(inside):
                seen.setdefault((place, _token(place, block)), []).append(pos)
            rows += [(site, own, place, token, len(at), at[0]) for (place, token), at in seen.items()]
            rows.append((site, own, 0, 0, 0, 0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "page", "place", "token", "n", "pos"])


def own_texts(pages: DataFrame) -> DataFrame:
    """(host, known): tokens that are the template's own text in the slots of each host's pages (host, main, html), counted over
    distinct articles, so copies of one don't support each other; and the places that have no other text."""
    rows = pages.mapInArrow(tidy(_texts), "host string, page long, place long, token long, n int, pos int")
    rows = saved(rows.dropDuplicates(["host", "page", "place", "token"]))
    totals = rows.where("n = 0").groupBy("host").agg(F.count("*").alias("pages"))
    rows = rows.where("n > 0")
    counts = rows.groupBy("host", "token", "place").agg(_vector(), F.count("*").alias("support"))
    frequent = saved(counts.join(small(saved(totals)), "host").where(_enough()))
    good = saved(_valid(rows, frequent, "token").where("valid"))
    covered = good.groupBy("host", "place").agg(F.sum("support").alias("covered"))
    present = rows.join(small(good.select("host", "place").distinct()), ["host", "place"], "left_semi").groupBy("host", "place").agg(F.count("*").alias("present"))
    whole = covered.join(present, ["host", "place"]).where("covered >= present").select("host", "place")
    return whole.union(good.select("host", "token")).groupBy("host").agg(F.collect_set("place").alias("known"))


def extracted(pages: DataFrame) -> DataFrame:
    """pages with a column text: the main text of the column html; url gives the host."""
    names = [c for c in pages.columns if c != "text"]
    kinds = ", ".join(f"`{k}` {t}" for k, t in pages.dtypes if k != "text")
    read = pages.select(F.struct(*(f"`{c}`" for c in names)).alias("row"), host("url").alias("host"), "html")
    mains = saved(template(pages.select("url", "html")))
    known = saved(own_texts(attach(read.select("host", "html"), mains, "host", "left")))
    joined = attach(attach(read.select("row", "host"), mains, "host", "left"), known, "host", "left").select("row.*", F.struct("main", "known").alias("_template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[int | None, frozenset[int]]] = {}
        for batch in batches:
            texts = []
            for page, t in zip(batch.column("html").to_pylist(), batch.column("_template").to_pylist(), strict=True):
                key = repr(t)
                if key not in sets:
                    if len(sets) > 100:
                        sets.clear()
                    sets[key] = t["main"], frozenset(t["known"] or ())
                texts.append(main_text(parsed(page or "")[0], *sets[key]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    return joined.mapInArrow(tidy(run), f"{kinds}, text string")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    out = extracted(only(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
