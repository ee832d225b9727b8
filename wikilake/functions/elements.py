"""The elements of an HTML page as an array of rows, so that selectors, ancestors and cuts are column expressions.

An element has its number in document order, the numbers of its ancestors and itself (its path), the places in the page where it
begins and ends, its tag, id, classes and attributes, and how many characters of text it holds.  Parsing is the only step in
Python; it works in Arrow batches and gives spans, not pages.  Null pages have no elements; pages of any length are read whole."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wikilake.functions.markdown import marked
from wikilake.functions.text import bound

ELEMENT = "array<struct<path:array<int>,begin:int,stop:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,chars:int>>"
# Elements without content, and which open elements a start tag ends (up to one that holds them back).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("td th table button caption html".split())


class _Reader(HTMLParser):
    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0, *(k + 1 for k in (i for i, c in enumerate(page) if c == "\n"))]
        self.page, self.rows, self.open, self.chars = page, [], [], 0
        page, self.mark = marked(page)  # of the same length
        self.feed(page)
        self.close()
        self._end(0, len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _plain(self, value: str) -> str:
        return value.replace(self.mark, "&") if self.mark else value

    def _end(self, depth: int, at: int) -> None:
        """Ends all open elements beyond a depth."""
        for n in self.open[depth:]:
            self.rows[n]["stop"] = at
            self.rows[n]["chars"] = self.chars - self.rows[n]["chars"]
        del self.open[depth:]

    def _nearest(self, tags, held) -> int | None:
        """The depth of the innermost open element of these tags, unless one that holds it back comes first."""
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.rows[self.open[depth]]["tag"]
            if tag in tags:
                return depth
            if tag in held:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        ended, held = ENDED_BY.get(tag, ({"p"}, HOLDS_P) if tag in ENDS_P else ((), ()))
        depth = self._nearest(ended, held)
        if depth is not None:
            self._end(depth, at)
        given = {}
        for name, value in attrs:
            given.setdefault(name, self._plain(value or ""))
        n = len(self.rows)
        path = [*(self.rows[self.open[-1]]["path"] if self.open else ()), n]
        self.rows.append({"path": path, "begin": at, "stop": at + len(self.get_starttag_text() or ""), "tag": tag, "id": given.get("id", ""), "classes": given.get("class", "").split(), "attrs": given, "chars": 0 if tag in VOID else self.chars})
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        depth = self._nearest({tag}, ())
        if depth is not None:
            at = self._at()
            stop = self.page.find(">", at)
            self._end(depth + 1, at)
            self._end(depth, len(self.page) if stop < 0 else stop + 1)

    def handle_data(self, data: str) -> None:
        self.chars += len(data)
        if self.open and self.rows[self.open[-1]]["tag"] == "title":
            own = self.rows[self.open[-1]]["attrs"]
            own["#text"] = own.get("#text", "") + self._plain(data)


def elements(page: Column) -> Column:
    """The elements of a page in document order; a title's attributes have its text as #text."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: _Reader(p).rows if p else [])

    return F.pandas_udf(run, ELEMENT)(page)


# --- selectors -------------------------------------------------------------------------------------------------------

STEP = "struct<tag:string,id:string,classes:array<string>,attrs:array<struct<name:string,how:string,value:string>>>"
_ATTRIBUTE = r"\[([\w-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]"


def parsed(selector: Column) -> Column:
    """A selector's steps from the outermost ancestor on: tag, #id, .class and [attribute] with =, *=, ^=, $= or ~=, descendants by spaces."""

    def step(x: Column) -> Column:
        bare = F.regexp_replace(x, r"\[[^\]]*\]", "")
        attribute = F.transform(F.regexp_extract_all(x, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, _ATTRIBUTE, 1).alias("name"), F.regexp_extract(a, _ATTRIBUTE, 2).alias("how"), F.regexp_extract(a, _ATTRIBUTE, 3).alias("value")))
        return F.struct(F.regexp_extract(bare, r"^([\w-]*)", 1).alias("tag"), F.regexp_extract(bare, r"#([\w-]+)", 1).alias("id"), F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), attribute.alias("attrs"))

    return F.transform(F.split(F.trim(selector), r"\s+(?![^\[]*\])"), step)


def fits(e: Column, step: Column) -> Column:
    """Whether an element is what one step asks for."""

    def has(a: Column) -> Column:
        v = F.coalesce(F.try_element_at(e.attrs, a["name"]), F.lit(""))
        there = F.map_contains_key(e.attrs, a["name"])
        return there & F.when(a.how == "", True).when(a.how == "=", v == a.value).when(a.how == "*=", F.contains(v, a.value)).when(a.how == "^=", v.startswith(a.value)).when(a.how == "$=", v.endswith(a.value)).otherwise(F.array_contains(F.split(v, r"\s+"), a.value))

    return ((step.tag == "") | (step.tag == e.tag)) & ((step.id == "") | (step.id == e.id)) & F.forall(step.classes, lambda c: F.array_contains(e.classes, c)) & F.forall(step.attrs, has)


def selected(rows: Column, steps: Column) -> Column:
    """The elements that a selector selects, in document order."""

    def above(e: Column, steps: Column) -> Column:  # ancestors from the nearest on use up the steps from the last but one on
        left = F.aggregate(F.reverse(e.path), F.size(steps) - 1, lambda left, n: F.when((left > 0) & (n != F.element_at(e.path, -1)) & F.coalesce(fits(F.get(rows, n), F.get(steps, left - 1)), F.lit(False)), left - 1).otherwise(left))
        return left == 0

    return bound(steps, lambda s: F.filter(rows, lambda e: fits(e, F.element_at(s, -1)) & F.when(F.size(s) == 1, True).otherwise(above(e, s))))


def common_ancestor(paths: Column) -> Column:
    """The longest prefix that all paths share.  The smallest and the largest of them share no more than that, so it can
    also be found by the aggregates min and max of a column of paths."""
    return bound(paths, lambda p: shared_prefix(F.array_min(p), F.array_max(p)))


def shared_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two arrays."""

    def prefix(p: Column) -> Column:
        differ = F.filter(F.transform(p.a, lambda x, i: F.when((i < F.size(p.b)) & (x == F.get(p.b, i)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return F.slice(p.a, 1, F.coalesce(F.array_min(differ), F.size(p.a)))

    return bound(F.struct(a.alias("a"), b.alias("b")), prefix)


def without(page: Column, begin: Column, stop: Column, cuts: Column) -> Column:
    """The page from begin to stop, with each of the cuts (begin, stop, text; in order, none in another) replaced by its text."""
    edge = F.struct(stop.alias("begin"), stop.alias("stop"), F.lit("").alias("text"))
    step = lambda a, c: F.struct(c.stop.alias("at"), F.array_append(a.out, F.concat(F.substring(page, a.at + 1, c.begin - a.at), c.text)).alias("out"))
    start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.array_append(cuts, edge), start, step, lambda a: a.out), "")
