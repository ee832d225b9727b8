"""Forum pages as tables of posts and pictures, and topics in Markdown.

A page is cut into its parts once, each with its place among the page's elements; posts, authors, dates and pictures meet by joins on these
places, and each post is converted on its own.  A topic gathers its own posts, no more.  Keys name the pages; a page without a post is no topic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from wikilake.functions import elements as E
from wikilake.functions import markdown as M
from wikilake.functions import text as T
from wikilake.sources.writers import scratch

# Where a topic page has its parts, the end of its title, and how it counts views.
TITLE, TITLE_END = ("h1", "title"), r"(?i)\s*[-–]\s*V2EX(?:/.*)?$"
HEADER, MEMBER, OPENING = (".header small.gray", ".header .small.gray", ".header .gray"), "a[href^='/member/']", (".topic_content .markdown_body", ".topic_content")
REPLY, NUMBER, USER, AGO, BADGE, CONTENT = "div[id^='r_'].cell", "span.no", "strong a[href^='/member/']", "span.ago[title]", ".badges .badge.op", ".reply_content"
VIEWS = r"(?i)(\d[\d,]*)\s*views?"


def inner(page: Column, e: Column) -> Column:
    """What stands between an element's tags."""
    return F.regexp_replace(F.regexp_replace(F.substring(page, e.begin + 1, e.stop - e.begin), r"\A<[^>]*>", ""), r"</[a-zA-Z][\w-]*\s*>\z", "")


def shown(page: Column, e: Column) -> Column:
    """An element's text, trimmed; the common character references are read."""
    text = F.regexp_replace(inner(page, e), r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: What a page is cut into: a kind, and the selectors of its elements.
KINDS = {"name": TITLE[:1], "title": TITLE[1:], "head": HEADER, "body": OPENING[:1], "old": OPENING[1:], "member": (MEMBER,), "dated": ("span[title]",), "reply": (REPLY,), "no": (NUMBER,), "user": (USER,), "ago": (AGO,), "badge": (BADGE,), "said": (CONTENT,), "image": ("img",)}
BODIES = ("body", "old", "said")


def parts(pages: DataFrame) -> DataFrame:
    """(key, kind, n, path, begin, text, html, title, src, alt): the elements of pages (key, html) that matter, each with its text, bodies with
    their html.  One pass over a page; what belongs together is joined by the numbers in the paths.  Written to the shared folder once."""
    rows, page = F.col("rows"), F.col("html")
    attr = lambda e, name: F.try_element_at(e.attrs, F.lit(name))

    none = F.lit(None).cast("string")
    wanted = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("selector")) for kind, selectors in KINDS.items() for x in selectors))

    def one(kind: Column, e: Column) -> Column:
        text = F.when(kind.isin(*BODIES, "reply", "image", "badge"), none).otherwise(shown(page, e))
        html = F.when(kind.isin(*BODIES), F.substring(page, e.begin + 1, e.stop - e.begin))
        return F.struct(kind.alias("kind"), F.element_at(e.path, -1).alias("n"), e.path.alias("path"), e.begin.alias("begin"), e.stop.alias("stop"), text.alias("text"), html.alias("html"), attr(e, "title").alias("title"), attr(e, "src").alias("src"), attr(e, "alt").alias("alt"))

    cut = pages.select("key", "html", E.elements(page).alias("rows"))
    hits = F.transform(wanted, lambda k: F.transform(E.selected(rows, E.parsed(k.selector)), lambda e: one(k.kind, e)))
    found = cut.select("key", F.explode(F.flatten(hits)).alias("x")).select("key", "x.*")
    folder = scratch(pages.sparkSession, "forum")
    found.write.parquet(folder)
    return pages.sparkSession.read.parquet(folder)


def _first(kind: str, *fields: str) -> Column:
    """Of the rows of a group the first of a kind, in document order; null if there is none."""
    own = F.col("kind") == kind
    return F.min_by(F.when(own, F.struct(*fields)), F.when(own, F.struct("begin", "n")))


def _below(found: DataFrame, owners: DataFrame, *kinds: str) -> DataFrame:
    """Rows of found of some kinds, each with the owner (key, owner) that it stands below."""
    return found.where(F.col("kind").isin(*kinds)).withColumn("owner", F.explode("path")).where("owner <> n").join(owners, ["key", "owner"])


def _date(x: Column) -> Column:
    return F.coalesce(F.when(x.title != "", x.title), x.text, F.lit(""))


def heads(found: DataFrame) -> DataFrame:
    """(key, title, username, date, views) of topics, from their parts."""
    per = found.groupBy("key").agg(_first("name", "text").alias("name"), _first("title", "text").alias("title"), _first("head", "n", "text").alias("head"))
    owners = per.where("head is not null").select("key", F.col("head.n").alias("owner"))
    own = _below(found, owners, "member", "dated").groupBy("key").agg(_first("member", "text").alias("by"), _first("dated", "title", "text").alias("at"))
    title = F.trim(F.regexp_replace(F.coalesce("name.text", "title.text", F.lit("")), TITLE_END, ""))
    views = F.replace(F.regexp_extract(F.coalesce("head.text", F.lit("")), VIEWS, 1), F.lit(","), F.lit("")).try_cast("long")
    return per.join(own, "key", "left").select("key", title.alias("title"), F.coalesce("by.text", F.lit("")).alias("username"), _date(F.col("at")).alias("date"), views.alias("views"))


def posts(found: DataFrame) -> DataFrame:
    """(key, no, username, date, op, html, pictures) of every post of topics, from their parts: the opening post is number 1, a reply's
    is the number it shows and one; those without a number or content are left out.  pictures (place, remote, local) are those with a web
    address; the html has their local names."""
    said = ("n", "begin", "html")
    opening = found.groupBy("key").agg(F.coalesce(_first("body", *said), _first("old", *said)).alias("said")).join(heads(found), "key")
    opening = opening.select("key", F.lit(1).alias("no"), "username", "date", F.lit(False).alias("op"), "said")
    replies = found.where("kind = 'reply'").select("key", F.col("n").alias("owner"))
    per = _below(found, replies, "no", "user", "ago", "badge", "said").groupBy("key", "owner").agg(_first("no", "text").alias("no"), _first("user", "text").alias("user"), _first("ago", "title", "text").alias("ago"), _first("badge", "n").alias("badge"), _first("said", *said).alias("said"))
    number = F.regexp_extract(F.coalesce("no.text", F.lit("")), r"^(\d{1,9})", 1).try_cast("int") + 1
    answers = per.select("key", number.alias("no"), F.coalesce("user.text", F.lit("")).alias("username"), _date(F.col("ago")).alias("date"), F.col("badge").isNotNull().alias("op"), "said")
    bare = F.regexp_replace(F.regexp_replace("said.html", r"\A<[^>]*>", ""), r"</[a-zA-Z][\w-]*\s*>\z", "")
    every = opening.unionByName(answers).where(F.col("no").isNotNull() & (F.trim(bare) != "")).withColumn("owner", F.col("said.n"))
    images = _below(found, every.select("key", "owner").distinct(), "image").where("src rlike '(?i)^https?://'")
    images = images.groupBy("key", "owner").agg(F.array_sort(F.collect_list(F.struct("begin", "stop", "src", F.coalesce("alt", F.lit("")).alias("alt")))).alias("images"))  # of one post
    remote = lambda e: F.regexp_replace(e.src, r"(?i)^https?://(?:www\.)?imgur\.com/", "https://i.imgur.com/")
    kind = lambda r: F.lower(F.regexp_extract(r, r"(?i)\.([a-z0-9]+)(?:[?#]|$)", 1))
    ending = lambda r: F.when((kind(r) == "") | (F.length(kind(r)) > 4), "jpg").otherwise(kind(r))
    renamed = F.transform(F.coalesce("images", F.array().cast("array<struct<begin:int,stop:int,src:string,alt:string>>")), lambda e, i: F.struct((i + 1).alias("place"), remote(e).alias("remote"), F.format_string("v2ex-%03d-%02d.%s", F.col("no"), i + 1, ending(remote(e))).alias("local"), (e.begin - F.col("said.begin")).alias("begin"), (e.stop - F.col("said.begin")).alias("stop"), e.alt.alias("alt")))
    each = every.join(images, ["key", "owner"], "left").withColumn("pictures", renamed)
    cuts = F.transform("pictures", lambda x: F.struct(x.begin.alias("begin"), x.stop.alias("stop"), F.concat(F.lit('<img alt="'), M.escaped(x.alt), F.lit('" src="'), x.local, F.lit('">')).alias("text")))
    whole = E.without(F.col("said.html"), F.lit(0), F.length("said.html"), cuts)
    return each.select("key", "no", "username", "date", "op", whole.alias("html"), F.transform("pictures", lambda x: F.struct(x.place.alias("place"), x.remote.alias("remote"), x.local.alias("local"))).alias("pictures"))


def _with_markdown(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [M.space_bold(M.to_markdown(x)) if x else "" for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "html"), pa.array(text, pa.string())], [*(n for n in b.schema.names if n != "html"), "body"])

    return rows.mapInArrow(run, T_.StructType([f for f in rows.schema.fields if f.name != "html"]).add("body", "string"))


def rendered(pages: DataFrame) -> DataFrame:
    """(key, title, posts, pictures, markdown) of topics with a post: a heading for each post, replies of the topic's author marked."""
    found = parts(pages)
    each = _with_markdown(posts(found).select("key", "no", "username", "date", "op", F.size("pictures").alias("pictures"), "html"))
    day = T.bound(F.col("date"), lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(d, 1, 10)).otherwise(d))
    who = F.when(F.col("username") == "", "anonymous").otherwise(F.col("username"))
    header = F.concat(F.lit("## #"), F.col("no").cast("string"), F.lit(" @"), who, F.when(day != "", F.concat(F.lit(" · "), day)).otherwise(""), F.when(F.col("op"), "  (OP comment)").otherwise(""))
    gathered = each.groupBy("key").agg(F.count("*").alias("posts"), F.sum("pictures").alias("pictures"), F.array_sort(F.collect_list(F.struct("no", F.concat(header, F.lit("\n\n"), "body", F.lit("\n")).alias("block")))).alias("blocks"))
    joined = gathered.join(heads(found).select("key", "title", "views"), "key").join(pages.select("key", "url"), "key")
    # The labels of the head.
    head = F.concat(F.lit("# "), F.when(F.col("title") == "", "(untitled)").otherwise(F.col("title")), F.lit("\n\n> 原文链接: "), F.coalesce("url", F.lit("")), F.lit("\n> 主题元信息: 共 "), F.col("posts").cast("string"), F.lit(" 楼"), F.coalesce(F.when(F.col("views") > 0, F.concat(F.lit(" · "), F.col("views").cast("string"), F.lit(" 浏览"))), F.lit("")), F.lit("\n\n---\n\n"))
    whole = F.concat(head, F.array_join(F.transform("blocks", lambda x: x.block), "\n"))
    return joined.select("key", "title", "posts", "pictures", F.concat(F.regexp_replace(F.regexp_replace(whole, r"\n{3,}", "\n\n"), r"\s+\z", ""), F.lit("\n")).alias("markdown"))
