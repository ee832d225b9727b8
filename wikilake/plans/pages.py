"""Queries over whole texts with markup spliced in: links, sections, counters, rewrites, cleanups, PDF text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.functions import pdf as P
from wikilake.functions import text as T
from wikilake.operators import curation, graph, links, quality, revisions
from wikilake.plans import adapters as A
from wikilake.plans.registry import registry
from wikilake.plans.spliced import CTE, pages

QUERIES, SQL, query = registry()
_OUT = "coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE out), '')"
_SECTION = """, heads AS (SELECT doc_id, min(place) FILTER (WHERE rtrim(line) = '## Observations') AS begin FROM numbered GROUP BY doc_id),
  ends AS (SELECT doc_id, begin, min(place) FILTER (WHERE place > begin AND regexp_matches(line, '^##? ')) AS stop FROM numbered JOIN heads USING (doc_id) GROUP BY doc_id, begin),
  inside AS (SELECT doc_id, line, place FROM numbered JOIN ends USING (doc_id) WHERE place > begin AND place < coalesce(stop, 1000000000)) """
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(CTE + f"SELECT doc_id, sha256({_OUT}) AS sha FROM numbered GROUP BY doc_id")
def page_fences(spark, d):
    return pages(spark, d).select("doc_id", F.sha2(T.strip_fences(F.col("body")).cast("binary"), 256).alias("sha"))


@query(CTE + "SELECT doc_id, count(DISTINCT link) AS links, min(link) AS first FROM (SELECT doc_id, trim(unnest(regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS link FROM numbered WHERE out) GROUP BY doc_id")
def page_links(spark, d):
    found = T.wikilinks(F.col("body"))
    return pages(spark, d).select("doc_id", F.size(found).cast("long").alias("links"), F.array_min(found).alias("first"))


@query(CTE + "SELECT doc_id, place AS line, trim(regexp_extract(link, '\\[\\[([^\\]|]+)', 1)) AS dst, link FROM (SELECT doc_id, place, unnest(regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 0)) AS link FROM numbered WHERE out AND doc_id % 3 <> 1)")
def page_citation_index(spark, d):
    bucket = F.when(F.col("doc_id") % 3 == 1, "00_Meta").otherwise("03_Sources")
    rows = graph.citation_index(pages(spark, d).select(F.col("doc_id").alias("repo_path"), bucket.alias("bucket"), "body"))
    return rows.select(F.col("path").alias("doc_id"), "line", "dst", "link")


@query(CTE + _SECTION + f"SELECT doc_id, sha256({_TRIM.format('string_agg(line, chr(10) ORDER BY place)')}) AS section, CAST(count(*) FILTER (WHERE starts_with(line, '- ')) AS INTEGER) AS bullets FROM inside GROUP BY doc_id")
def page_section(spark, d):
    b = F.col("body")
    return pages(spark, d).select("doc_id", F.sha2(T.section(b, "Observations").cast("binary"), 256).alias("section"), F.size(T.observations(b)).alias("bullets"))


@query(
    CTE
    + """, heads AS (SELECT doc_id, min(place) AS begin FROM numbered WHERE trim(line) = '## Observations' GROUP BY doc_id),
    two AS (SELECT doc_id, min(place) AS stop FROM numbered JOIN heads USING (doc_id) WHERE place > begin AND starts_with(line, '## ') GROUP BY doc_id), six AS (SELECT doc_id, min(place) AS stop FROM numbered JOIN heads USING (doc_id) WHERE place > begin AND regexp_matches(line, '^#{1,6} ') GROUP BY doc_id)
    SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE place < two.stop)) AS second, sha256(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE place < six.stop)) AS least FROM numbered JOIN heads USING (doc_id) JOIN two USING (doc_id) JOIN six USING (doc_id) WHERE place > begin GROUP BY doc_id"""
)
def page_section_forms(spark, d):
    """A section up to the next heading of level two, or of any level, as it stands; the first of several names that is there."""
    b = F.col("body")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return pages(spark, d).select("doc_id", sha(T.section(b, "Missing", "Observations", until=T.SECOND, trimmed=False)).alias("second"), sha(T.section(b, "Observations", "End", until=T.ANY, trimmed=False)).alias("least"))


@query(CTE + """, more AS (SELECT doc_id, list_filter(string_split(concat(' Share ', chr(10), t, chr(10), '分享', chr(10), 'Share it', chr(10), 'x 附录（位置未识别）'), chr(10)), lambda x: true) AS x FROM docs),
  f AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS place FROM more), g AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) % 2 = 0 AS out FROM f)
  SELECT doc_id, CAST(count(*) FILTER (WHERE out AND trim(line) IN ('Subscribe', 'Share', 'Copy link', 'Comment', 'Like', 'Save', 'Follow', 'More', 'Open in App', '订阅', '分享', '复制链接', '评论', '点赞', '关注', '收藏')) AS INTEGER) AS chrome, CAST(count(*) FILTER (WHERE out AND contains(line, '附录（位置未识别）')) AS INTEGER) AS appendix_marks FROM g GROUP BY doc_id""")
def page_chrome(spark, d):
    text = F.concat(F.lit(" Share \n"), F.col("t"), F.lit("\n分享\nShare it\nx 附录（位置未识别）"))
    found = T.features(text)
    return pages(spark, d).select("doc_id", found["chrome"].alias("chrome"), found["appendix_marks"].alias("appendix_marks"))


@query(
    CTE
    + """SELECT doc_id, concat('---', chr(10), 'type: topic', chr(10), CASE doc_id % 3 WHEN 0 THEN concat('updated: 2024-05-06', chr(10), 'synthesis_updated_at: 2024-05-06', chr(10)) WHEN 1 THEN concat('synthesis_updated_at: 2024-05-06', chr(10), 'updated: 2024-05-06', chr(10)) ELSE concat('synthesis_updated_at: 2024-05-06', chr(10)) END, '---', chr(10)) AS head,
    sha256(regexp_replace(concat('# T', chr(10), t, chr(10), '## What', chr(10), chr(10), 'new ', doc_id, chr(10), chr(10), '## End', chr(10), t), '\\n{3,}', concat(chr(10), chr(10)), 'g')) AS body FROM docs WHERE NOT regexp_matches(t, '(^|\\n)\\s*## What\\s*(\\n|$)')"""
)
def pages_refined(spark, d):
    """A section replaced and its day set, in three kinds of frontmatter; no text has a section of that name itself."""
    s, i = F.lit, F.col("doc_id")
    dates = F.when(i % 3 == 0, "updated: 2020-01-01\n").when(i % 3 == 1, "synthesis_updated_at: x\nupdated: 2020-01-01\n").otherwise("")
    raw = F.concat(s("---\ntype: topic\n"), dates, s("---\n# T\n"), F.col("t"), s("\n## What\nold\n## End\n"), F.col("t"))
    rows = pages(spark, d).where(~F.col("t").rlike(r"(^|\n)\s*## What\s*(\n|$)")).select("doc_id", curation.refined(raw, "What", F.concat(s("\n new "), i.cast("string"), s(" ")), "2024-05-06").alias("new"))
    return rows.select("doc_id", T.frontmatter(F.col("new")).alias("head"), F.sha2(T.body(F.col("new")).cast("binary"), 256).alias("body"))


@query(
    CTE
    + """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'comparison' ELSE 'survey' END AS shape, CASE WHEN doc_id % 2 = 0 THEN '| a |' ELSE '' END AS comparison, concat('about ', doc_id) AS what, sha256(concat('### Source: 2024-01-0', doc_id % 5 + 1, '-s', chr(10), chr(10), '## Key claims', chr(10), regexp_replace(regexp_extract(concat(chr(10), s.t, chr(10), '## '), '(?s)^(.*?)\\n##? ', 1), '^\\s+|\\s+$', '', 'g'))) AS sources, '2024-01-09-x' AS unresolved
    FROM docs JOIN (SELECT doc_id AS k, t FROM docs WHERE doc_id < 5) s ON s.k = docs.doc_id % 5"""
)
def topic_contexts(spark, d):
    """Each topic cites one of five documents as its source, and one that isn't there."""
    s, i = F.lit, F.col("doc_id")
    p = pages(spark, d)
    slug = lambda k: F.concat(s("2024-01-0"), (k % 5 + 1).cast("string"), s("-s"))
    given = p.where("doc_id < 5")
    sources = given.select(slug(i).alias("slug"), F.concat(s("# S\n## Key claims\n"), F.col("t"), s("\n## Raw source\nno")).alias("body"))
    body = F.concat(s("## What\nabout "), i.cast("string"), s("\n## Current understanding\n[[03_Sources/2024/2024-01-09-x.md]] [["), slug(i), s("|s]] [[other]]\n"), F.when(i % 2 == 0, "## Comparison\n| a |\n").otherwise(""), s("## End\n"), F.col("t"))
    rows = curation.topic_context(p.join(F.broadcast(given.select((i % 5).alias("k"))), i % 5 == F.col("k"), "left_semi").select(i.alias("slug"), body.alias("body")), sources)  # five rows at most
    return rows.select(F.col("slug").alias("doc_id"), "shape", "comparison", "what", F.sha2(F.col("sources").cast("binary"), 256).alias("sources"), F.array_join(F.filter("unresolved", lambda x: x == "2024-01-09-x"), ",").alias("unresolved"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('T ', source) WHEN 1 THEN lang ELSE concat('PDF: ', doc_id) END AS title, CASE WHEN doc_id % 2 = 0 THEN '2024-08-19 16:30' ELSE concat('in ', lang) END AS made FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def pdf_metadata(spark, d):
    s, i = F.lit, F.col("doc_id")
    rows = A.table(spark, d, "documents").where("lang is not null and source is not null")
    title = P.choose_title(F.when(i % 3 == 0, F.concat(s("T "), "source")).otherwise(""), F.when(i % 3 == 1, F.col("lang")), i.cast("string"))
    return rows.select("doc_id", title.alias("title"), P.pdf_date(F.when(i % 2 == 0, "D:20240819163025+02'00'").otherwise(F.concat(s("in "), "lang"))).alias("made"))


@query(
    CTE
    + """SELECT doc_id, CAST(count(*) FILTER (WHERE out AND starts_with(line, '# ')) AS INTEGER) AS h1, CAST(count(*) FILTER (WHERE out AND starts_with(line, '## ')) AS INTEGER) AS h2, CAST(count(*) FILTER (WHERE fence) AS INTEGER) AS fences,
    CAST(count(*) FILTER (WHERE out AND len(string_split(line, '**')) % 2 = 0) AS INTEGER) AS unbalanced_bold, CAST(count(*) FILTER (WHERE out AND regexp_matches(line, '^#{1,6}\\s*$')) AS INTEGER) AS empty_headings,
    CAST(count(*) FILTER (WHERE out AND regexp_matches(line, '^\\|[\\s:|-]+\\|\\s*$')) AS INTEGER) AS tables FROM numbered GROUP BY doc_id"""
)
def page_features(spark, d):
    found = pages(spark, d).select("doc_id", T.feature_row(F.col("body")).alias("f"))
    return found.select("doc_id", *(F.col("f")[k].alias(k) for k in ("h1", "h2", "fences", "unbalanced_bold", "empty_headings", "tables")))


_RENAMED = "CASE WHEN out THEN regexp_replace(line, '\\[\\[\\s*a 3\\s*(\\|[^\\]]*)?\\]\\]', '[[new\\1]]', 'g') ELSE line END"


@query(CTE + f"SELECT doc_id, sha256(string_agg({_RENAMED}, chr(10) ORDER BY place)) AS sha, bool_or({_RENAMED} <> line) AS changed FROM numbered GROUP BY doc_id")
def page_rename(spark, d):
    rows = curation.renamed(pages(spark, d).select("doc_id", F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("slug"), "body"), "a 3", "new")
    return rows.select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "changed")


@query(CTE + "SELECT doc_id, sha256(string_agg(CASE WHEN out THEN regexp_replace(line, '\\*{4,}', '**', 'g') ELSE line END, chr(10) ORDER BY place)) AS sha FROM numbered GROUP BY doc_id")
def page_asterisks(spark, d):
    return pages(spark, d).select("doc_id", F.sha2(T.collapse_asterisks(F.col("body")).cast("binary"), 256).alias("sha"))


@query(CTE + "SELECT doc_id, sha256(string_agg(CASE WHEN out THEN replace(replace(replace(line, '[[b|see]]', '[see](https://w/b)'), '[[a 3]]', '[a 3](https://w/a%203)'), concat('[[a ', doc_id % 7, ']]'), concat('[a ', doc_id % 7, '](wiki-unresolved:a%20', doc_id % 7, ')')) ELSE line END, chr(10) ORDER BY place)) AS sha FROM numbered WHERE place > 1 GROUP BY doc_id")
def page_prepared(spark, d):
    urls = F.create_map(F.lit("b"), F.lit("https://w/b"), F.lit("a 3"), F.lit("https://w/a%203"))
    return pages(spark, d).select("doc_id", F.sha2(T.prepared(F.col("body"), urls).cast("binary"), 256).alias("sha"))


@query(CTE + "SELECT doc_id, sha256(string_agg(CASE WHEN out THEN replace(replace(line, '[[b|see]]', '[see](https://w/11)'), concat('[[a ', doc_id % 7, ']]'), CASE WHEN doc_id % 7 % 2 = 0 THEN concat('[a ', doc_id % 7, '](https://w/', doc_id % 7, ')') ELSE concat('[a ', doc_id % 7, '](wiki-unresolved:a%20', doc_id % 7, ')') END) ELSE line END, chr(10) ORDER BY place)) AS sha FROM numbered WHERE place > 1 GROUP BY doc_id")
def page_links_joined(spark, d):
    """Links by a join with the documents of even numbers, and number 11, as the table of slugs."""
    i = F.col("doc_id")
    slugs = A.table(spark, d, "documents").where("doc_id % 2 = 0 or doc_id = 11").select(F.when(i == 11, "b").otherwise(F.concat(F.lit("a "), i.cast("string"))).alias("slug"), F.concat(F.lit("https://w/"), i.cast("string")).alias("url"))
    rows = links.prepared(pages(spark, d).select(i.alias("key"), F.col("body").alias("raw")), slugs)
    return rows.select(F.col("key").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query(CTE + "SELECT doc_id, sha256(t) AS headless, concat('page ', doc_id) AS title FROM bodies")
def page_title(spark, d):
    head = F.concat(F.lit("# [2024-05-06] page "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("t"))
    return pages(spark, d).select("doc_id", F.sha2(T.strip_leading_h1(head).cast("binary"), 256).alias("headless"), T.human_title(head).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '... [truncated]') ELSE text END AS text FROM documents")
def error_clamped(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.clamp(F.col("text")).alias("text"))


@query(CTE + "SELECT doc_id, CAST(len(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1)) * 4 + 2 AS INTEGER) AS images, len(list_filter(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)', 1), lambda u: regexp_matches(u, '^(https?:)?//'))) AS remote FROM bodies")
def page_images(spark, d):
    b = F.col("body")
    return pages(spark, d).select("doc_id", (F.size(T.local_images(b)) + F.size(T.remote_images(b))).alias("images"), F.size(T.remote_images(b)).cast("long").alias("remote"))


@query(CTE + "SELECT doc_id, sha256(concat('# page ', doc_id, ' and more', chr(10), '---', chr(10), t, chr(10), '## Sub heading', chr(10), 'x :smile: [a_b](http://h/1) y', chr(10), chr(10), t)) AS sha FROM bodies WHERE t <> ''")
def page_cleanup(spark, d):
    """A page with what seven of the stages take away; the texts themselves have nothing for them."""
    s = F.lit
    name = F.col("doc_id").cast("string")
    dirty = F.concat(
        s("# page "), name, s("\n---\n# page "), name, s(" and more\n\n"), F.col("t"), s("\nShare\n"), s("## **Sub** *heading*\n"), s('x ![:smile:](https://h.org/emoji/a.png ":smile:")[](#top) <text color="red">[a\\_b](http://h/1)</text> y\n[![me](https://h/me.png)](/users/me)\n'), s("Subscribe\n\n"), F.col("t"), s("\n\n[a](/tag/a)[b](/tag/b)"),
    )
    rows = pages(spark, d).where("t <> ''").select("doc_id", M.post_cleanups(dirty, F.lit("https://h.org/p")).alias("c"))
    return rows.select("doc_id", F.sha2(F.col("c.text").cast("binary"), 256).alias("sha"))


@query(
    CTE
    + """SELECT doc_id, rule, count(*) AS n FROM (SELECT doc_id, unnest(['escaped-image', 'escaped-emoji', 'empty-heading', 'multi-line-link', 'blank-run']) AS rule FROM docs
    UNION ALL SELECT doc_id, 'blank-run' FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\n{3,}')) FROM docs) UNION ALL SELECT doc_id, 'asterisk-run' FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '\\*{4,}')) GROUP BY ALL"""
)
def page_structure(spark, d):
    """Each rule but that of glued bolds (see the tests) broken once in a page, before its whole text; what the text breaks itself comes on top."""
    s = F.lit
    text = F.concat(s("a \\!\\[x b\n:big\\_smile: c\n##\n[\n\n![i](j)\n\n](http://x)\nword**bold** d\n\n\n```\n\\!\\[ in a fence\n#\n```\n`\\!\\[ in code`\n"), F.col("t"))
    rows = pages(spark, d).select("doc_id", F.explode(M.issues(text)).alias("i")).where("i.rule <> 'bold-glued'")
    return rows.groupBy("doc_id", F.col("i.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(concat('Abstract', chr(10), 'We show that this is a long line of prose with the words of it. REPRINT inter-', 'nal end.', chr(10), chr(10), n_chars, ' is the size of it.', chr(10))) AS sha FROM documents")
def pdf_cleaned(spark, d):
    s = F.lit
    raw = F.concat(s("   A Title\n   Some Author\n\narXiv:2401.01234v2 [cs.CL] 1 Jan\n  Abstract\nWe show that this is a long line of prose with the words of it. R EPRINT inter-\n nal end.\n12\n\nSpeed\n\nModel A\n\nPreprint. Under review.\n"), F.col("n_chars").cast("string"), s(" is the size of it.\n\n\n"))
    return A.table(spark, d, "documents").select("doc_id", F.sha2(P.pdf_text(raw).cast("binary"), 256).alias("sha"))


@query("SELECT doc_id, concat('FLUX model ', doc_id, ': A second line') AS title FROM documents")
def pdf_titles(spark, d):
    return A.table(spark, d, "documents").select("doc_id", P.title_of_pdf(F.concat(F.lit("arXiv: 2401.1 something\n12 May 2024\nshort\n  F LUX model "), F.col("doc_id").cast("string"), F.lit(":\nA second line\n"), F.coalesce("text", F.lit("")))).alias("title"))


@query(
    CTE
    + """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'not-html' WHEN 1 THEN 'not-found' WHEN 2 THEN 'bot-challenge' WHEN 3 THEN 'not-html' WHEN 4 THEN 'not-found' ELSE CASE WHEN doc_id % 4 = 1 THEN 'bot-challenge' END END AS kind FROM docs"""
)
def page_signatures(spark, d):
    k, s = F.col("doc_id") % 6, F.lit
    title = F.when(k == 1, "Page Not Found - x").when(k == 2, "Just a moment...").otherwise("A page")
    ray = F.when(F.col("doc_id") % 4 == 1, "You have been blocked. Cloudflare Ray ID: 1 ").otherwise("Cloudflare Ray ID: 2 ")
    text = F.concat(F.when(k == 0, "%PDF-1.7 ").when(k == 4, "410 Gone ").when(k == 5, ray).otherwise(""), F.col("t"))
    kind = F.when(k == 3, "image/png").otherwise("text/html; charset=utf-8")
    return pages(spark, d).select("doc_id", quality.page_signature(title, text, kind).alias("kind"))


@query(
    CTE
    + """SELECT doc_id, concat('https://cdn/', source, '/a.png') AS ref FROM docs WHERE doc_id % 4 > 1 UNION ALL SELECT doc_id, concat('https://cdn/', source, '/b.png') FROM docs WHERE doc_id % 4 = 3"""
)
def refs_missing(spark, d):
    s = F.lit
    body = F.concat(F.col("t"), s("\n![x [y] z](https://cdn/"), "source", s("/a.png) and `https://cdn/"), "source", s("/b.png` end"))
    p = pages(spark, d)
    rows = p.select(F.col("doc_id").alias("path"), body.alias("body"))
    have = p.where("doc_id % 4 < 2").select(F.explode(F.array(F.concat("source", s("/a.png")), F.concat("source", s("/b.png")))).alias("key"), F.col("doc_id").alias("path")).union(p.where("doc_id % 4 = 2").select(F.concat("source", s("/b.png")), "doc_id"))
    keyed = F.concat(F.col("path").cast("string"), s("/"), F.col("key")).alias("key")  # each page has a folder of its own
    own = rows.withColumn("body", F.regexp_replace("body", "https://cdn/", F.concat(s("https://cdn/"), F.col("path").cast("string"), s("/"))))
    out = revisions.missing_refs(own, have.select(keyed), "https://cdn")
    return out.select(F.col("path").alias("doc_id"), F.concat(s("https://cdn/"), F.regexp_replace("key", "^[0-9]+/", "")).alias("ref"))


@query(CTE + "SELECT doc_id, concat('![a](https://pub/', doc_id, '/images/a.png) <img src=\"https://pub/', doc_id, '/images/b.png\">', t) AS text, CAST(2 AS INTEGER) AS n FROM docs WHERE NOT regexp_matches(t, '(\\]\\(|src=\")\\.?/?images/')")
def refs_rewritten(spark, d):
    p = pages(spark, d).where(~F.col("t").rlike(r"(\]\(|src=\")\.?/?images/"))
    raw = F.concat(F.lit('![a](./images/a.png) <img src="images/b.png">'), F.col("t"))
    text, n = revisions.rewrite_refs(raw, "https://pub/DOC")
    return p.select("doc_id", F.regexp_replace(text, "https://pub/DOC", F.concat(F.lit("https://pub/"), F.col("doc_id").cast("string"))).alias("text"), n.alias("n"))


@query(CTE + ", u AS (SELECT doc_id, t, concat('## Current understanding', chr(10), t) AS s FROM docs) SELECT doc_id, concat('# x', chr(10), chr(10), '## What', chr(10), 'new ', doc_id, chr(10), '## End', chr(10), t) AS body, 'comparison' AS shape FROM u")
def section_replaced(spark, d):
    s = F.lit
    b = F.concat(s("# x\n\n## What\nold "), F.col("t"), s("\n## End\n"), F.col("t"))
    ok = pages(spark, d)
    new = curation.with_section(F.regexp_replace(b, r"(?s)(## What\nold ).*?(\n## End\n)", "$1$2"), "What", F.concat(s("new "), F.col("doc_id").cast("string")))
    return ok.select("doc_id", new.alias("body"), curation.topic_shape(F.concat(F.col("t"), s("\n## Comparison\n"))).alias("shape"))


@query(CTE + """SELECT doc_id, concat('- [ ] ', doc_id) AS open, doc_id % 2 = 0 AS approved, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, concat('wiki rename ', doc_id) AS command, 'because of it' AS rationale, CAST(doc_id % 100 AS INTEGER) AS n FROM docs""")
def queue_parsed(spark, d):
    s, i = F.lit, F.col("doc_id").cast("string")
    text = F.concat(
        s("# Queue\n"), F.regexp_replace("t", "(?m)^#", " #"), s("\n\n### "), (F.col("doc_id") % 100).cast("string"), s(". Rename it [confidence: "), F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low"),
        s("]\n- ["), F.when(F.col("doc_id") % 2 == 0, "x").otherwise(" "), s("] approved\n**Rationale**: because of it\n```\n# a comment\nwiki rename "), i, s("\n```\n## Done\n- [x] approved"),
    )
    rows = pages(spark, d).select("doc_id", F.explode(curation.queue_items(text)).alias("q"))
    return rows.select("doc_id", F.concat(s("- [ ] "), F.col("doc_id").cast("string")).alias("open"), "q.approved", "q.confidence", "q.command", "q.rationale", "q.n")


@query(
    CTE
    + """, own AS (SELECT doc_id, regexp_replace(concat('one: a = b', chr(10), regexp_replace(t, '^\\s+', ''), chr(10), '```'), '(?s)\\n```.*', '') AS x FROM docs)
    SELECT doc_id, CAST(2 AS INTEGER) AS parts, sha256(regexp_replace(x, '\\s+$', '')) AS one, concat('two = ', doc_id) AS two FROM own"""
)
def batch_parsed(spark, d):
    s, i = F.lit, F.col("doc_id").cast("string")
    text = F.concat(s("Here is it:\n\n=== entity: one ===\n\nold\n=== entity: gone ===\n\n=== entity: two ===\ntwo = "), i, s("\n```\nbye\n=== entity: one ===\none: a = b\n"), F.regexp_replace("t", r"\A\s+", ""), s("\n```"))
    rows = pages(spark, d).select("doc_id", curation.batch_parts(text).alias("b"))
    of = lambda name: F.element_at(F.filter("b", lambda x: x["name"] == name), 1).text
    return rows.select("doc_id", F.size("b").alias("parts"), F.sha2(of("one").cast("binary"), 256).alias("one"), of("two").alias("two"))


@query(
    CTE
    + """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'b' END AS sources, CASE doc_id % 4 WHEN 0 THEN 'b,c' ELSE 'c' END AS unresolved, sha256(regexp_replace(regexp_extract(concat(chr(10), t, chr(10), '## '), '(?s)^(.*?)\\n##? ', 1), '^\\s+|\\s+$', '', 'g')) AS synthesis, CAST(2 AS INTEGER) AS bullets FROM docs"""
)
def entity_contexts(spark, d):
    s = F.lit
    p = pages(spark, d)
    body = F.concat(s("## Synthesis\n"), F.col("t"), s("\n## Observations\n- from [[b|x]] and [[c]]\n- again [[03_Sources/2024/b]]\n"))
    docs = p.select(F.col("doc_id").alias("slug"), body.alias("body"))
    known = spark.range(1).select(s("b").alias("slug"), s("## Summary\nwhat b says").alias("body"))
    one, none = curation.entity_context(docs.where("slug % 4 <> 0"), known, ("Summary",)), curation.entity_context(docs.where("slug % 4 = 0"), known.limit(0), ("Summary",))
    out = one.unionByName(none)
    return out.select(F.col("slug").alias("doc_id"), F.when(F.col("sources") == "### Source: b\n\n## Summary\nwhat b says", "b").otherwise(F.col("sources")).alias("sources"), F.array_join("unresolved", ",").alias("unresolved"), F.sha2(F.col("synthesis").cast("binary"), 256).alias("synthesis"), F.size("observations").alias("bullets"))


@query(CTE + "SELECT doc_id AS name, sha256(regexp_replace(regexp_extract(concat(chr(10), t, chr(10), '## '), '(?s)^(.*?)\\n##? ', 1), '^\\s+|\\s+$', '', 'g')) AS what, concat('known ', doc_id) AS understanding, lang AS updated FROM docs WHERE doc_id % 3 > 0")
def top_contexts(spark, d):
    s = F.lit
    p = pages(spark, d)
    body = F.concat(s("## What\n"), F.col("t"), s("\n## Current understanding\n"), F.when(F.col("doc_id") % 3 == 0, "_TBD_").otherwise(F.concat(s("known "), F.col("doc_id").cast("string"))))
    rows = curation.top_context(p.select(F.col("doc_id").alias("slug"), body.alias("body"), F.lit(None).cast("string").alias("synthesised"), F.col("lang").alias("updated")))
    return rows.select("name", F.sha2(F.col("what").cast("binary"), 256).alias("what"), "understanding", "updated")


@query(
    CTE
    + """SELECT doc_id, CASE WHEN doc_id = 5 THEN concat('## What', chr(10), chr(10), 'target', chr(10), chr(10), '<!-- merged from `page 3` on 2024-01-02 -->', chr(10), chr(10), 'source', chr(10), chr(10), '## Open threads', chr(10), chr(10), '<!-- merged from `page 3` on 2024-01-02 -->', chr(10), chr(10), 'threads', chr(10)) ELSE concat('see [[page 5]] ', t) END AS body FROM docs WHERE doc_id <> 3"""
)
def topics_merged(spark, d):
    s, i = F.lit, F.col("doc_id")
    body = F.when(i == 3, "## What\nsource\n## Open threads\nthreads\n").when(i == 5, "## What\ntarget\n").otherwise(F.concat(s("see [[page 3]] "), F.col("t")))
    docs = pages(spark, d).select("doc_id", F.concat(s("page "), i.cast("string")).alias("slug"), body.alias("body"))
    return curation.merged_topics(docs, "page 3", "page 5", "2024-01-02").select("doc_id", "body")
