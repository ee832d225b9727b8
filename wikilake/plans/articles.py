"""Queries over the elements of pages: ancestors by paths, bodies of articles by rules, whole articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import elements as E
from wikilake.operators import articles, forums
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry

QUERIES, SQL, query = registry()
_HOLDERS = ("html", "head", "body", "nav", "ul", "article", "footer", "div")
#: What lies between the tags of an article, as text.
_INNER = "regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"
_READ = "replace(replace(replace(replace(replace({}, '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TEXT = _READ.format("regexp_replace({}, '<[^>]*>', '', 'g')")
_TITLE = "trim(" + _READ.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + ")"


@query(
    f"""WITH tags AS (SELECT page_id, html, unnest(['li', 'a', 'p']) AS tag FROM pages),
    found AS (SELECT page_id, html, tag, CAST(len(regexp_extract_all(html, concat('<', tag, '[ >]'))) AS BIGINT) AS n, length(regexp_extract(html, concat('(?s)^(.*?)<', tag, '[ >]'), 1)) AS first, length(regexp_extract(html, concat('(?s)^(.*)<', tag, '[ >]'), 1)) AS last FROM tags),
    held AS (SELECT *, unnest([{", ".join(f"'{t}'" for t in _HOLDERS)}]) AS holder FROM found WHERE n > 0),
    placed AS (SELECT *, length(regexp_extract(html, concat('(?s)^(.*?)<', holder, '[ >]'), 1)) AS begin, CASE WHEN contains(html, concat('</', holder, '>')) THEN length(regexp_extract(html, concat('(?s)^(.*?)</', holder, '>'), 1)) ELSE length(html) END AS stop, regexp_matches(html, concat('<', holder, '[ >]')) AS there FROM held)
    SELECT page_id, tag, n, arg_max(holder, begin) AS ancestor FROM placed WHERE there AND begin < first AND stop > last GROUP BY page_id, tag, n"""
)
def page_ancestors(spark, d):
    """The nearest element that holds all links, items or paragraphs of a page: paths are aggregated to their minimum and maximum."""
    rows = A.table(spark, d, "pages").select("page_id", F.posexplode(E.elements(F.col("html"))).alias("n", "e"))
    paths = rows.where(F.col("e.tag").isin("li", "a", "p")).groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"), F.min("e.path").alias("low"), F.max("e.path").alias("high"))
    above = F.slice("low", 1, F.size("low") - 1)
    shared = paths.withColumn("at", F.element_at(F.when(F.col("n") == 1, above).otherwise(E.shared_prefix(F.col("low"), F.col("high"))), -1))
    named = rows.select("page_id", F.col("n").alias("at"), F.col("e.tag").alias("ancestor"))
    return shared.join(named, ["page_id", "at"]).select("page_id", "tag", "n", "ancestor")


@query(f"SELECT page_id, 'article' AS tag, CAST(length({_TEXT.format(_INNER)}) AS INTEGER) AS chars, {_TITLE} AS title FROM pages")
def article_bodies(spark, d):
    """The element that the default site's rules choose, and the page's title."""
    books = articles.rulebook(articles.site_rules(spark)).where("site = '_default'").select(F.struct("*").alias("book"))
    rows = A.table(spark, d, "pages").select("page_id", E.elements(F.col("html")).alias("rows")).join(F.broadcast(books))  # one row
    body = articles.chosen_body(F.col("rows"), F.col("book.bodies"))
    return rows.select("page_id", body.alias("e"), articles.described(F.col("rows"), F.col("book")).alias("h")).select("page_id", "e.tag", "e.chars", "h.title")


#: A page's title and article in the dress of four sites: url, end of the title, what stands before and behind the article in its body.
_DRESS = (
    ("https://blog.csdn.net/a/", " - CSDN博客", '<div class="x"><div id="content_views">', '<div class="recommend-box"><p>more</p></div></div></div>'),
    ("https://lmsys.org/blog/", " | LMSYS Org", '<section class="blog-post"><p class="share wide">share</p><div>', "</div><nav><p>next</p></nav></section>"),
    ("https://docs.readthedocs.io/en/", "", '<div class="rst-content"><div class="wy-menu"><p>menu</p></div>', '<footer>end</footer></div><div class="rst-content">short</div>'),
    ("https://www.anthropic.com/news/", r" \ Anthropic", "<main>", '<div class="LinkGrid-module__root"><p>grid</p></div></main>'),
)


def _dressed(spark, d):
    k, s = F.col("page_id") % 4, F.lit
    of = lambda i: F.when(k == 0, _DRESS[0][i]).when(k == 1, _DRESS[1][i]).when(k == 2, _DRESS[2][i]).otherwise(_DRESS[3][i])
    inner = F.concat(s("<p>"), F.rpad(s(""), 200, "x"), s("</p>"), F.regexp_extract("html", r"(?s)<article>(.*?)(?:</article>|\z)", 1))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    page = F.concat(
        s('<html><head><title>'), title, of(1), s('</title><meta name="author" content=" Ann "><meta property="article:author" content="Bob"><meta content="Ann" name="author"><meta itemprop="datePublished" content="2024-03-0'), (F.col("page_id") % 9 + 1).cast("string"), s('T10:00"><meta property="og:description" content="about"></head><body>'),
        of(2), inner, of(3), s("</body></html>"),
    )
    return A.table(spark, d, "pages").select("page_id", F.concat(of(0), F.col("page_id").cast("string")).alias("url"), page.alias("html"))


@query(
    f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'blog-csdn' WHEN 1 THEN 'lmsys' WHEN 2 THEN 'readthedocs' ELSE 'anthropic' END AS site, {_TITLE} AS title, concat('2024-03-0', page_id % 9 + 1) AS published, 'Ann,Bob' AS authors, 'about' AS description,
    regexp_replace({_TEXT.format(f"concat('<p>', repeat('x', 200), '</p>', {_INNER})")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS letters FROM pages"""
)
def site_articles(spark, d):
    """Articles in the dress of four sites: the rules find the body, cut the chrome and end the title; letters of the Markdown's text."""
    rows = articles.articles(_dressed(spark, d), articles.site_rules(spark))
    bare = F.regexp_replace("body", r"[^\p{L}\p{N}]+", "")
    return rows.select("page_id", "site", "title", "published", F.array_join("authors", ",").alias("authors"), "description", bare.alias("letters"))


@query()
def page_articles(spark, d):
    """Whole articles; golden pages are in the tests."""
    rows = articles.articles(A.table(spark, d, "pages"), articles.site_rules(spark))
    return rows.select("page_id", "site", "title", "markdown")


@query(
    """WITH t AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, role, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS x FROM conversations)
    SELECT key, no, role AS username, concat('2024-01-0', no % 9 + 1) AS date, no > 1 AND no % 2 = 1 AS op, regexp_replace(x, '[^\\p{L}\\p{N}]+', '', 'g') AS letters, concat('v2ex-', printf('%03d', no), '-01.png') AS picture FROM t"""
)
def forum_posts(spark, d):
    """Each conversation as a topic's page: its first turn opens it, the others are replies with a picture each."""
    s = F.lit
    turn = F.struct("turn", "role", F.replace(F.replace(F.col("text"), s("&"), s("&amp;")), s("<"), s("&lt;")).alias("text"))
    talks = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    said = lambda x, i: F.concat(x.text, s(' <img src="https://h.org/'), i.cast("string"), s('.PNG">'))
    date = lambda i: F.concat(s("2024-01-0"), ((i + 1) % 9 + 1).cast("string"), s(" 10:00"))
    member = lambda x: F.concat(s('<a href="/member/'), x.role, s('">'), x.role, s("</a>"))
    reply = lambda x, i: F.concat(
        s('<div id="r_'), i.cast("string"), s('" class="cell"><span class="no">'), i.cast("string"), s("</span><strong>"), member(x), s("</strong>"), F.when(i % 2 == 0, '<div class="badges"><div class="badge op">OP</div></div>').otherwise(""), s('<span class="ago" title="'), date(i), s('">ago</span><div class="reply_content">'), said(x, i), s("</div></div>"),
    )
    first = F.col("turns")[0]
    page = F.concat(s("<h1>Topic - V2EX</h1><div class='header'><small class='gray'>"), member(first), s(" <span title='"), date(s(0)), s("'>ago</span></small></div><div class='topic_content'>"), said(first, s(0)), s("</div>"), F.array_join(F.slice(F.transform("turns", reply), 2, F.size("turns")), ""))
    posts = forums.posts(forums.parts(talks.select(F.col("conv_id").alias("key"), page.alias("html"))))
    letters = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"[^\p{L}\p{N}]+", "")
    return posts.select("key", F.col("no").cast("long").alias("no"), "username", F.substring("date", 1, 10).alias("date"), "op", letters.alias("letters"), F.col("pictures")[0].local.alias("picture"))
