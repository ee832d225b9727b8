"""Articles of pages by rules in a table: which element is the body, what is cut out of it, how the title ends.

Rules (site, action, place, value) are data.  They meet pages by the site that a URL is routed to and are interpreted on the page's
elements, all in one row, so whole pages are never shuffled; a table of rules is broadcast if its counted size allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from wikilake.functions import elements as E
from wikilake.functions import markdown as M
from wikilake.functions import text as T
from wikilake.functions import urls as U

#: Characters of text that a body needs, and bodies of one selector that make a list of a page.
LEAST_CHARS, LISTED = 200, 3
#: Rules that may be broadcast.
MOST_RULES = 10_000

# Of each site the selectors of its body in order, what is dropped, the end of titles, and the rest.
_RST = ".wy-nav-side .wy-side-nav-search .wy-menu .rst-footer-buttons .rst-versions .wy-breadcrumbs .breadcrumbs .edit-link"
SITES: dict[str, dict[str, str]] = {
    "readthedocs": {"body": ".rst-content, [itemprop='articleBody'], .document, article, main", "drop": f".headerlink a.headerlink {_RST} nav.wy-nav-top nav footer"},
    "qwenlm-github-io": {"body": ".post-content, article.post-single, article, main", "title": r"\s*\|\s*Qwen\s*$", "drop": ".post-meta .post-tags .paginav .share-buttons .related-posts nav footer", "images": "qwenlm"},
    "01-me": {"body": "article .content, .post-body, .content, article, main", "title": r"\s*[-|·]\s*01\.me\s*$", "drop": ".post-nav .post-copyright .post-related .comments .post-toc nav footer"},
    "blog-csdn": {"body": "#content_views, article.baidu_pl, article, main", "title": r"\s*[-_|]\s*CSDN(?:博客)?\s*$", "drop": ".article-info-box .article-bar-bottom .operating .recommend-box .recommend-right .comment-box .csdn-side-toolbar .more-toolbox .vip-recommend .meau-style nav footer"},
    "lmsys": {"body": ".blog-post-content, .blog-post, article, main", "title": r"\s*[-|]\s*LMSYS\s*(?:Org)?\s*$", "drop": ".blog-post-meta .author-card .share .tags .related .post-navigation .comments nav footer"},
    "aleksagordic": {"body": ".prose, article, main", "title": r"\s*-\s*Aleksa\s+Gordić\s*$", "demote": "h1"},
    "docs-nvidia": {"body": "main .rst-content, div[itemprop='articleBody'], .rst-content, article, main", "title": r"\s*[-—]\s*NVIDIA\s+Docs\s*$", "drop": f"{_RST} .headerlink nav.wy-nav-top nav footer"},
    "developer-nvidia": {"body": "article .entry-content, .entry-content, article, main", "title": r"\s*\|\s*NVIDIA(?:\s+(?:Technical\s+Blog|Developer))?\s*$", "drop": ".entry-meta .author-bio .share .social-share .related-posts .post-navigation .comments-area .tags .breadcrumb nav footer"},
    "anthropic": {"body": "article, main, .post-body, .article-body, [role='main']", "title": r"\s*[\\|]\s*Anthropic\s*$", "drop": "nav footer aside header .nav .navigation .breadcrumbs .share .social-share .related .related-posts .author-bio .tags .meta .byline .cta .newsletter [class*='LinkGrid'] [class*='ContactCard'] svg"},
    "blog-google": {"body": ".article-container__content, .uni-container.article-container, article .article-body, .article-body, article, main", "title": r"\s*\|\s*Google\s*$", "drop": ".article-share__title .copy-link__dialog .uni-blog-landing__nav .article-related-posts .author-bio .uni-social-share .uni-article-progress-bar .article-meta__container .article-meta__author-container .uni-blog-article-tags .article-tags .article-hero nav footer", "lazy": "data-loading"},
    "sebastianraschka-blog": {"body": "article, main, .post-content, .content, [role='main']", "drop": "nav footer aside header .nav .navigation .breadcrumbs .share .social-share .newsletter .subscribe .follow .tags .tag-list .post-meta .post-navigation .pagination .prev-next", "images": "sebastianraschka"},
    "sohu": {"body": "article.article, div.article, #mp-editor, .text, article, main", "title": r"\s*[-_]\s*搜狐(?:新闻|网|号)?\s*$", "drop": ".article-info .article-source .original-source .article-share .user-info .article-news .article-recommend .article-comment .content-tools .content-tools-box .head-tools .god-article-bottom .side-bar .sidebar .hot-list .recommend .comment .article-tag .author-card .profile [class*='back-comment'] [class*='right-comment'] [class*='comment-item'] [class*='comment-box'] [class*='comment-publish'] [class*='comment-input'] [class*='login'] [class*='passport'] .sidebar-box .side-layer .article-back .back-top .back-home .back-comment-foot .feedback nav footer"},
    U.DEFAULT_SITE: {"body": "article, main, [role='main'], .prose, .post-content, .article-body, .entry-content, .content", "drop": "nav footer aside header .nav .navigation .breadcrumb .breadcrumbs .share .share-buttons .social-share .social .related .related-posts .related-stories .comments .comment-section .cookie-banner .cookie-notice .sidebar .side-bar .author-bio .author-card .tags .tag-list .meta .byline .post-meta .post-navigation .pagination .paginav", "demote": "h1", "images": "default"},
}


def site_rules(spark: SparkSession, sites: dict[str, dict[str, str]] = SITES) -> DataFrame:
    """(site, action, place, value) of the sites above: a row a selector."""
    rows = []
    for site, rules in sites.items():
        for action, value in {"images": site, **rules}.items():
            values = value.split(", ") if action == "body" else value.split(" ") if action == "drop" else [value]
            rows += [(site, action, k, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, action string, place int, value string")


def rulebook(rules: DataFrame) -> DataFrame:
    """A row a site: its selectors, parsed and in order, and its other rules."""
    of = lambda action: F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == action, F.struct("place", E.parsed(F.col("value")).alias("steps"))))), lambda x: x.steps)
    single = lambda action: F.max(F.when(F.col("action") == action, F.col("value"))).alias(action)
    replaced = F.collect_list(F.when(F.col("action") == "replace", F.struct(E.parsed(F.regexp_extract("value", r"^(.*?)\s*=>", 1)).alias("steps"), F.regexp_extract("value", r"=>\s*(.*)$", 1).alias("text"))))
    return rules.groupBy("site").agg(of("body").alias("bodies"), of("drop").alias("drops"), replaced.alias("replaces"), *map(single, ("title", "demote", "lazy", "images")))


def chosen_body(rows: Column, bodies: Column) -> Column:
    """The element of the body: of the first selector with hits of enough text its first hit, or, from LISTED hits on, their common
    ancestor below the page's own elements; else the first article, main or body element; null if there is none."""

    def listed(hits: Column, shared: Column) -> Column:
        top = F.get(rows, F.element_at(shared, -1))
        below = F.get(rows, F.get(hits[0].path, F.size(shared)))  # the next element towards the first hit
        wide = T.bound(top, lambda t: F.when(t.tag.isin("html", "body"), F.coalesce(below, t)).otherwise(t))
        return T.bound(wide, lambda w: F.when(w.chars >= LEAST_CHARS, w).otherwise(hits[0]))

    def of(hits: Column) -> Column:
        paths = F.transform(hits, lambda e: e.path)
        return F.when(F.size(hits) < LISTED, hits[0]).otherwise(T.bound(E.common_ancestor(paths), lambda shared: F.when(F.size(shared) > 0, listed(hits, shared)).otherwise(hits[0])))

    first = F.aggregate(bodies, F.filter(rows, lambda e: F.lit(False)), lambda found, steps: F.when(F.size(found) > 0, found).otherwise(F.filter(E.selected(rows, steps), lambda e: e.chars >= LEAST_CHARS)))
    named = lambda tag: F.get(F.filter(rows, lambda e: e.tag == tag), F.lit(0))
    return T.bound(first, lambda hits: F.when(F.size(hits) > 0, of(hits)).otherwise(F.coalesce(named("article"), named("main"), named("body"))))


def _cuts(rows: Column, body: Column, book: Column) -> Column:
    """What is cut out of a body, or replaced: (begin, stop, text), none in another."""
    drops = F.flatten(F.transform(book.drops, lambda steps: F.transform(E.selected(rows, steps), lambda e: F.struct(e.path.alias("path"), e.begin.alias("begin"), e.stop.alias("stop"), F.lit("").alias("text")))))
    replaced = F.flatten(F.transform(book.replaces, lambda r: F.transform(E.selected(rows, r.steps), lambda e: F.struct(e.path.alias("path"), e.begin.alias("begin"), e.stop.alias("stop"), F.concat(F.lit("<p>"), r.text, F.lit("</p>")).alias("text")))))
    source = lambda e: F.coalesce(F.get_json_object(F.try_element_at(e.attrs, book.lazy), "$.desktop"), F.get_json_object(F.try_element_at(e.attrs, book.lazy), "$.mobile"), F.when(F.trim(F.try_element_at(e.attrs, F.lit("srcset"))) != "", M.largest_source(F.try_element_at(e.attrs, F.lit("srcset")))))
    sourced = F.transform(F.filter(rows, lambda e: e.tag == "img"), lambda e: F.struct(e.alias("e"), source(e).alias("src")))
    image = lambda x: F.struct(x.e.path.alias("path"), x.e.begin.alias("begin"), x.e.stop.alias("stop"), F.concat(F.lit('<img alt="'), M.escaped(F.coalesce(F.try_element_at(x.e.attrs, F.lit("alt")), F.lit(""))), F.lit('" src="'), M.escaped(x.src), F.lit('">')).alias("text"))
    images = F.transform(F.filter(sourced, lambda x: x.src.isNotNull()), image)
    inner = lambda cuts: F.filter(cuts, lambda c: F.array_contains(c.path, F.element_at(body.path, -1)) & (F.size(c.path) > F.size(body.path)))
    return _outermost(inner(F.concat(drops, replaced, images)))


def _outermost(cuts: Column) -> Column:
    """Those that lie in no other, each once, by place; of two for one element the drop."""
    ordered = F.array_sort(F.transform(cuts, lambda c: F.struct(c.begin.alias("begin"), (-c.stop).alias("back"), c.text.alias("text"), c.stop.alias("stop"))))
    step = lambda a, c: F.when(c.begin < a.upto, a).otherwise(F.struct(c.stop.alias("upto"), F.array_append(a.kept, F.struct(c.begin.alias("begin"), c.stop.alias("stop"), c.text.alias("text"))).alias("kept")))
    start = F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<begin:int,stop:int,text:string>>").alias("kept"))
    return F.aggregate(ordered, start, step, lambda a: a.kept)


def _metas(rows: Column, *names: str) -> Column:
    """The first filled content of a meta element of one of these names, in their order."""
    of = lambda name: F.get(F.filter(F.transform(F.filter(rows, lambda e: (e.tag == "meta") & ((F.try_element_at(e.attrs, F.lit(name.split(":", 1)[0])) == name.split(":", 1)[1]))), lambda e: F.trim(F.coalesce(F.try_element_at(e.attrs, F.lit("content")), F.lit("")))), lambda v: v != ""), F.lit(0))
    return F.coalesce(*map(of, names), F.lit(""))


def described(rows: Column, book: Column) -> Column:
    """title, description, published (a day if it is one) and authors of a page."""
    text = F.get(F.transform(F.filter(rows, lambda e: e.tag == "title"), lambda e: F.regexp_replace(F.coalesce(F.try_element_at(e.attrs, F.lit("#text")), F.lit("")), r"^\s+|\s+$", "")), F.lit(0))
    whole = T.bound(_metas(rows, "property:og:title"), lambda og: F.when(og != "", og).otherwise(F.coalesce(text, F.lit(""))))
    title = F.trim(T.bound(whole, lambda t: F.when(book.title.isNotNull(), F.regexp_replace(t, book.title, F.lit(""))).otherwise(t)))
    published = _metas(rows, "property:article:published_time", "name:article:published_time", "property:og:updated_time", "itemprop:datePublished")
    by = F.filter(rows, lambda e: (e.tag == "meta") & (F.coalesce(F.try_element_at(e.attrs, F.lit("property")) == "article:author", F.lit(False)) | F.coalesce(F.try_element_at(e.attrs, F.lit("name")) == "author", F.lit(False))))
    authors = F.array_distinct(F.filter(F.transform(by, lambda e: F.trim(F.coalesce(F.try_element_at(e.attrs, F.lit("content")), F.lit("")))), lambda v: v != ""))
    return F.struct(
        T.bound(title, lambda t: F.when(t == "", F.concat(F.lit("("), book.images, F.lit(" article)"))).otherwise(t)).alias("title"),
        _metas(rows, "property:og:description").alias("description"),
        T.bound(published, lambda p: F.when(p.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(p, 1, 10)).otherwise(p)).alias("published"),
        authors.alias("authors"),
    )


def _demoted(page: Column) -> Column:
    for level in range(5, 0, -1):
        page = F.regexp_replace(page, rf"(?i)<(/?)h{level}(?=[\s>/])", f"<$1h{level + 1}")
    return page


def _with_markdown(rows: DataFrame) -> DataFrame:
    """rows with body, the Markdown of cut.  An operator of its own: Spark leaves a Python function in place whose argument holds
    nested lambdas, and then can't evaluate it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [M.space_bold(M.to_markdown(x)) if x else "" for x in b.column("cut").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "cut"), pa.array(text, pa.string())], [*(n for n in b.schema.names if n != "cut"), "body"])

    schema = T_.StructType([f for f in rows.schema.fields if f.name != "cut"]).add("body", "string")
    return rows.mapInArrow(run, schema)


def articles(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, site, title, description, published, authors, body, markdown) of pages (page_id, url, html): the body in Markdown, and
    the whole article under its head.  Sites without rules take those of the default site; a page without elements has an empty body."""
    books = rulebook(rules)
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        books = F.broadcast(books)
    known = [r.site for r in rules.select("site").distinct().limit(MOST_RULES).collect()]  # a row a site
    site = T.bound(U.route_site(F.col("url")), lambda routed: F.when(routed.isin(*known), routed).otherwise(U.DEFAULT_SITE))
    rows = pages.select("page_id", "url", "html", site.alias("site"), E.elements(F.col("html")).alias("rows"))
    rows = rows.join(books.select("site", F.struct(*(c for c in books.columns if c != "site")).alias("book")), "site", "left")
    rows = rows.withColumn("element", chosen_body(F.col("rows"), F.col("book.bodies")))
    whole = F.coalesce(F.col("element.begin"), F.lit(0)), F.coalesce(F.col("element.stop"), F.length("html"))
    cut = F.when(F.col("element").isNull(), F.col("html")).otherwise(E.without(F.col("html"), *whole, _cuts(F.col("rows"), F.col("element"), F.col("book"))))
    rows = rows.select("page_id", "url", "site", described(F.col("rows"), F.col("book")).alias("head"), T.bound(cut, lambda c: F.when(F.col("book.demote").isNotNull(), _demoted(c)).otherwise(c)).alias("cut"))
    rows = _with_markdown(rows)
    line = lambda before, value: F.when(value != "", F.concat(F.lit(before), value, F.lit("\n"))).otherwise("")
    h = F.col("head")
    # The labels of the head.
    head = F.concat(F.lit("# "), h.title, F.lit("\n\n"), line("> 原文链接: ", F.coalesce("url", F.lit(""))), line("> 作者: ", F.array_join(h.authors, ", ")), line("> 发表于: ", h.published), line("> ", h.description), F.lit("\n---\n\n"), F.col("body"), F.lit("\n"))
    return rows.select("page_id", "url", "site", "head.*", "body", F.regexp_replace(F.regexp_replace(head, r"\n{3,}", "\n\n"), r"\n+\z", "\n").alias("markdown"))
