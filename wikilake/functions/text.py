"""Markdown columns.  Lines inside a fence (from a line that starts with three backticks to the next) don't count
where the docstring says `outside fences`.  Lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def _runs(text: Column) -> Column:
    """The text cut before every fence line: (text, n, more).  Of the parts numbered from the first fence on, odd ones begin
    with the line that opens a fence, even ones with the line that closes it; 0 is what stands before.  more: another part follows."""
    return bound(F.split(text, r"(?md)(?=^```)", -1), lambda p: F.transform(p, lambda x, i: F.struct(x.alias("text"), (i + F.when(p[0].startswith("```"), 1).otherwise(0)).alias("n"), (i + 1 < F.size(p)).alias("more"))))


def _unix(text: Column) -> Column:
    """Line breaks of one character."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _rows(text: Column, more: Column) -> Column:
    """Lines of a part; the line break before the next part ends the last of them."""
    return F.when(more & (text == ""), F.array().cast("array<string>")).otherwise(lines(F.when(more, F.regexp_replace(text, r"\r?\n\z", "")).otherwise(text)))


def _behind(part: Column) -> Column:
    """What follows the first line of a part."""
    return F.regexp_replace(part, r"\A[^\n]*\n?", "")


def _outside(text: Column) -> Column:
    """Array of what stands between the fence lines outside of fences, each without its last line break; what has no line isn't there."""

    def kept(t: Column, more: Column) -> Column:
        return F.when(~more, t).when(t != "", F.substring(t, F.lit(1), F.length(t) - 1))

    part = lambda p: F.when(p.n == 0, kept(p.text, p.more)).when((p.n % 2 == 0) & F.contains(p.text, F.lit("\n")), kept(_behind(p.text), p.more))
    return F.array_compact(F.transform(_runs(_unix(text)), part))


def outside_fences(text: Column) -> Column:
    """Array of the lines outside fences, without the fence lines."""
    return F.flatten(F.transform(_outside(text), lambda t: F.split(t, "\n", -1)))


def strip_fences(text: Column) -> Column:
    return F.array_join(_outside(text), "\n")


def wikilinks(text: Column) -> Column:
    """Distinct targets of [[target]] and [[target|alias]], trimmed, outside fences."""
    found = F.regexp_extract_all(strip_fences(text), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def frontmatter(raw: Column) -> Column:
    """The block between --- lines at the very start, with them; empty if there is none."""
    return F.regexp_extract(raw, r"(?s)\A(---\r?\n.*?\r?\n---\r?\n)", 1)


def body(raw: Column) -> Column:
    return F.substring(raw, F.length(frontmatter(raw)) + 1, F.length(raw))


def frontmatter_map(raw: Column) -> Column:
    """Flat keys and values as text; quotes around a value are dropped."""
    rows = F.filter(lines(frontmatter(raw)), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pair = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"^[\"'](.*)[\"']$", "$1")))
    return F.map_from_entries(pair)


SPACE = " \t\n\x0b\f\r"
#: Headings at which a section ends: of level one or two, of level two alone, or any.
TOP, SECOND, ANY = r"^##? ", r"^## ", r"^#{1,6} "


def section(text: Column, *headings: str, until: str = TOP, trimmed: bool = True) -> Column:
    """The body of the first of the sections `## heading` that is there, up to the next heading (see TOP), or the end; null if none
    is there.  The heading's line may have white space around it."""

    whole = _unix(text)

    def one(heading: str) -> Column:
        behind = F.get(F.split(whole, rf"(?md)^ *## {quoted(heading)} *$", 2), F.lit(1))  # null without the heading
        cut = F.split(behind, "(?md)" + until, 2)
        if trimmed:
            return F.btrim(F.get(cut, F.lit(0)), F.lit(SPACE))
        own = F.get(cut, F.lit(0))  # from the break behind the heading to the one before the next
        return F.substring(own, F.lit(2), F.length(own) - F.size(cut))

    return F.coalesce(*map(one, headings))


def excerpt(text: Column, headings: tuple[str, ...]) -> Column:
    """The named sections, with their headings; the whole text if none is there."""
    parts = [F.concat(F.lit(f"## {h}\n"), section(text, h)) for h in headings]
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), text)


def observations(text: Column) -> Column:
    """Bullets of the Observations section."""
    return F.regexp_extract_all(F.coalesce(section(text, "Observations"), F.lit("")), F.lit(r"(?md)^- [^\n]*$"), F.lit(0))


def is_stub(text: Column) -> Column:
    """An empty or placeholder section."""
    return text.isNull() | (F.trim(text) == "") | F.lower(text).rlike(r"^\s*[_*(]*(tbd|todo|stub|placeholder|pending)")


def strip_leading_h1(text: Column) -> Column:
    return F.regexp_replace(text, r"\A(\s*)# [^\n]*\n?", "$1")


def first_h1(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^# (.+)$", 1)


def human_title(text: Column) -> Column:
    """The first H1 without a leading [date]."""
    return F.trim(F.regexp_replace(first_h1(text), r"^\[\d{4}-\d{2}-\d{2}\]\s*", ""))


def first_paragraph(text: Column, most: int = 137) -> Column:
    """The first line of text that is no heading, cut."""
    rows = F.filter(lines(body(text)), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    line = F.coalesce(F.try_element_at(rows, F.lit(1)), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def image_urls(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), F.regexp_extract_all(text, F.lit("<img[^>]*src=\"([^\"]+)\""), F.lit(1)))


def local_images(text: Column) -> Column:
    return F.filter(image_urls(text), lambda x: ~x.rlike(r"^(https?:)?//|^data:"))


def remote_images(text: Column) -> Column:
    return F.filter(image_urls(text), lambda x: x.rlike(r"^(https?:)?//"))


def structure(text: Column) -> dict[str, Column]:
    """Characters, headings, fence lines, table rows and images, fences not regarded."""
    rows = lines(text)
    count = lambda rule: F.size(F.filter(rows, lambda x: x.rlike(rule)))
    return {"chars": F.length(text), "headings": count(r"^#{1,6} "), "fences": count(r"^```"), "table_rows": count(r"^\|.*\|\s*$"), "images": F.size(image_urls(text))}


# Lines that are the label of a button, and the mark of an appendix without a place.
CHROME_LINES = ("Subscribe", "Share", "Copy link", "Comment", "Like", "Save", "Follow", "More", "Open in App", "订阅", "分享", "复制链接", "评论", "点赞", "关注", "收藏")
APPENDIX_MARK = "附录（位置未识别）"


def feature_row(text: Column) -> Column:
    """Counters that a page's snapshot is compared by, as one struct; headings count outside fences.  Where several are asked for, select the
    struct before its fields: so the text is read once."""

    def of(rows: Column) -> Column:
        return bound(F.array_join(F.regexp_extract_all(rows, F.lit(r"(?md)^#[^\n]*$"), F.lit(0)), "\n"), lambda heads: counted(rows, heads))

    def counted(rows: Column, heads: Column) -> Column:
        count = lambda rule, within=rows: F.regexp_count(within, F.lit("(?md)" + rule))
        bars = F.when(F.contains(rows, F.lit("|")), count(r"^\|[ \t\x0B\f\r:|-]+\|[ \t\x0B\f\r]*$")).when(rows.isNotNull(), 0)
        holding = lambda x: F.regexp_extract_all(rows, F.lit(rf"(?md)^[^\n]*?{quoted(x)}[^\n]*$"), F.lit(0))
        found = {
            "h1": count("^# ", heads),
            "h2": count("^## ", heads),
            "h3": count("^### ", heads),
            "fences": F.regexp_count(text, F.lit("(?md)^```")),
            "tables": bars,
            "images": F.size(image_urls(text)),
            "remote_images": F.size(remote_images(text)),
            "body_chars": F.length(F.trim(text)),
            "unbalanced_bold": F.when(F.contains(rows, F.lit("**")), F.size(F.filter(holding("**"), lambda x: F.size(F.split(x, r"\*\*")) % 2 == 0))).when(rows.isNotNull(), 0),
            "empty_headings": count(r"^#{1,6}[ \t\x0B\f\r]*$", heads),
            "frontmatter": (frontmatter(text) != "").cast("int"),
            "chrome": count(rf"^ *(?:{'|'.join(map(quoted, CHROME_LINES))}) *$"),
            "appendix_marks": F.when(F.contains(rows, F.lit(APPENDIX_MARK)), F.size(holding(APPENDIX_MARK))).when(rows.isNotNull(), 0),
        }
        return F.struct(*(c.alias(k) for k, c in found.items()))

    return bound(strip_fences(text), of)


FEATURES = ("h1", "h2", "h3", "fences", "tables", "images", "remote_images", "body_chars", "unbalanced_bold", "empty_headings", "frontmatter", "chrome", "appendix_marks")


def features(text: Column) -> dict[str, Column]:
    """The fields of feature_row by their names."""
    row = feature_row(text)
    return {k: row[k] for k in FEATURES}


def fenced_lines(text: Column) -> Column:
    """Array of (line, fenced): whether a line is a fence or inside of one."""
    marked = lambda p: F.transform(_rows(p.text, p.more), lambda line, i: F.struct(line.alias("line"), ((p.n % 2 == 1) | ((p.n > 0) & (i == 0))).alias("fenced")))
    return F.flatten(F.transform(_runs(text), marked))


def outside(text: Column, f: Callable[[Column], Column]) -> Column:
    """f on each part of the text that is outside fences; fences that stay open go to the end."""
    part = lambda p: F.when(p.n == 0, f(p.text)).when(p.n % 2 == 1, p.text).otherwise(F.concat(F.regexp_extract(p.text, r"\A([^\n]*\n?)", 1), f(_behind(p.text))))
    return F.array_join(F.transform(_runs(text), part), "")


def collapse_asterisks(text: Column) -> Column:
    """Runs of four asterisks and more to two, outside fences."""
    return outside(text, lambda t: F.regexp_replace(t, r"\*{4,}", "**"))


def clamp(text: Column, most: int = 2000, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def _exponential(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else f"{x:.2e}")


def format_cell(text: Column) -> Column:
    """A dash for nothing, an exponential form from a billion on, else the escaped text.  The exponential form is that of the number's
    exact binary value, ties to even; the JVM's own rounds the shortest decimal form up."""
    n = text.try_cast("double") if hasattr(text, "try_cast") else text.cast("double")
    large = F.when((F.abs(n) >= 1e9) & ~F.isnan(n), n)
    return F.when(text.isNull() | (F.trim(text) == ""), "-").when(large.isNotNull(), F.pandas_udf(_exponential, "string")(large)).otherwise(escape_cell(text))


def glob_rule(glob: str) -> str:
    """A regular expression for a glob of * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c) for c in glob) + "$"


def quoted(text: str) -> str:
    """A text as a pattern of itself."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def rewrite_links(text: Column, old: str, new: str) -> Column:
    """[[old]] and [[old|alias]] to the new target, outside fences; aliases stay."""
    return outside(text, lambda t: F.regexp_replace(t, rf"\[\[\s*{quoted(old)}\s*(\|[^\]]*)?\]\]", f"[[{new}$1]]"))


def link_places(text: Column) -> Column:
    """Array of (line from 1, target, link) of all wikilinks outside fences, each occurrence of its own."""
    rows = F.transform(fenced_lines(text), lambda x, i: F.struct((i + 1).alias("n"), x.fenced.alias("fenced"), x.line.alias("line")))
    kept = F.filter(rows, lambda x: ~x.fenced & F.contains(x.line, F.lit("[[")))
    return F.flatten(F.transform(kept, lambda x: F.transform(F.regexp_extract_all(x.line, F.lit(LINK), F.lit(0)), lambda m: F.struct(x.n.alias("line"), F.trim(F.regexp_extract(m, LINK, 1)).alias("target"), m.alias("link")))))


UNRESOLVED = "wiki-unresolved:"


def link_pieces(text: Column) -> Column:
    """The text as an array of (slug, shown, text): a link [[slug]] or [[slug|shown]] outside fences, within a line, or none, and the text
    that follows it."""
    none = F.lit(None).cast("string")
    plain = lambda t: F.struct(none.alias("slug"), none.alias("shown"), t.alias("text"))

    def piece(x: Column) -> Column:  # what stands after a pair of brackets
        def link(inner: Column) -> Column:
            slug = F.trim(F.regexp_extract(inner, r"^([^|]*)", 1))
            shown = F.trim(F.when(F.contains(inner, F.lit("|")), F.regexp_extract(inner, r"\|(.*)$", 1)).otherwise(inner))
            return F.struct(slug.alias("slug"), shown.alias("shown"), F.substring(x, F.length(inner) + 3, F.length(x)).alias("text"))

        return F.when(x.rlike(r"\A[^\]|\n]+(?:\|[^\]\n]+)?\]\]"), bound(F.regexp_extract(x, r"\A([^\]]*)\]\]", 1), link)).otherwise(plain(F.concat(F.lit("[["), x)))

    def pieces(t: Column) -> Column:
        return bound(F.split(t, r"\[\[", -1), lambda x: F.concat(F.array(plain(x[0])), F.transform(F.slice(x, 2, F.size(x)), piece)))

    part = lambda p: F.when(p.n == 0, pieces(p.text)).when(p.n % 2 == 1, F.array(plain(p.text))).otherwise(F.concat(F.array(plain(F.regexp_extract(p.text, r"\A([^\n]*\n?)", 1))), pieces(_behind(p.text))))
    return F.flatten(F.transform(_runs(text), part))


def rendered_link(slug: Column, shown: Column, url: Column, missing: str = "placeholder") -> Column:
    """[shown](url); without a url a placeholder, plain text, or, if missing is fail, an error."""
    of = {
        "placeholder": lambda: F.concat(F.lit("["), shown, F.lit(f"]({UNRESOLVED}"), F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")), F.lit(")")),
        "plain": lambda: shown,
        "fail": lambda: F.raise_error(F.concat(F.lit("unresolved link: "), slug)).cast("string"),
    }[missing]()
    return F.when(url.isNotNull(), F.concat(F.lit("["), shown, F.lit("]("), url, F.lit(")"))).otherwise(of)


def resolved_links(text: Column, urls: Column, missing: str = "placeholder") -> Column:
    """[[slug]] and [[slug|text]] to [text](url), outside fences.  urls: a map from slugs, for few of them; operators.links
    joins a table.  What it lacks becomes a placeholder, plain text, or, if missing is fail, an error."""
    one = lambda x: F.when(x.slug.isNull(), x.text).otherwise(F.concat(rendered_link(x.slug, x.shown, F.try_element_at(urls, x.slug), missing), x.text))
    return F.array_join(F.transform(link_pieces(text), one), "")


def headless(raw: Column) -> Column:
    """The body of a page without the leading H1 and the blank lines behind it."""
    return bound(body(raw), lambda text: F.when(text.rlike(r"\A\s*#\s+\S"), F.regexp_replace(text, r"\A\s*#[^\n]*(\n\s*(?=\S|\z)|\n?\z)", "")).otherwise(text))


def prepared(raw: Column, urls: Column, missing: str = "placeholder") -> Column:
    """A page to be sent: its frontmatter as it is, its body headless, links resolved."""
    return F.concat(frontmatter(raw), resolved_links(headless(raw), urls, missing))
