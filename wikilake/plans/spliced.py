"""Whole texts of documents with markup before, inside and behind them, and SQL that reads their lines.

The SQL does fences by counting: a line stands outside if an even number of fence lines comes before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.plans import adapters as A

#: A page of each document: links, a fence that every fifth page leaves open, sections, images.
PAGE = """concat('# page ', doc_id, chr(10), '[[a ', doc_id % 7, ']]', chr(10), t, chr(10), '```', chr(10), '[[hidden]]', chr(10), '# hidden', chr(10), t, chr(10), CASE WHEN doc_id % 5 = 4 THEN '' ELSE concat('```', chr(10)) END,
  t, chr(10), '## Observations', chr(10), '- [[b|see]] seen ', lang, chr(10), t, chr(10), '- [[a ', doc_id % 7, ']] ****x****', chr(10), '## End', chr(10), t, chr(10), '![i](./x.png) ![j](http://h/y.png)')"""
#: pages: doc_id, t, body and rows (line, place from 1, out: outside fences).
CTE = f"""WITH docs AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS t FROM documents), bodies AS (SELECT doc_id, lang, source, t, {PAGE} AS body FROM docs),
  split AS (SELECT *, string_split(body, chr(10)) AS x FROM bodies),
  marked AS (SELECT *, list_transform(x, lambda y: starts_with(y, '```')) AS f FROM split),
  lines AS (SELECT doc_id, unnest(x) AS line, unnest(f) AS fence, generate_subscripts(x, 1) AS place FROM marked),
  numbered AS (SELECT doc_id, line, place, fence, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) % 2 = 0 AND NOT fence AS out FROM lines) """


def pages(spark, d) -> DataFrame:
    """doc_id, lang, source, t and body."""
    i, k, s, t = F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string"), F.lit, F.coalesce("text", F.lit(""))
    fence = F.when(F.col("doc_id") % 5 == 4, "").otherwise("```\n")
    parts = (s("# page "), i, s("\n[[a "), k, s("]]\n"), t, s("\n```\n[[hidden]]\n# hidden\n"), t, s("\n"), fence, t, s("\n## Observations\n- [[b|see]] seen "), F.coalesce("lang", s("")), s("\n"), t, s("\n- [[a "), k, s("]] ****x****\n## End\n"), t, s("\n![i](./x.png) ![j](http://h/y.png)"))
    return A.table(spark, d, "documents").select("doc_id", "lang", "source", t.alias("t"), F.concat(*parts).alias("body"))
