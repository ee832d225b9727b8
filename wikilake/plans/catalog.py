"""All queries of the library and the SQL that they must equal."""

from __future__ import annotations

from wikilake.plans import articles, checks, documents, graph, ledgers, pages, pipeline, reports, streams, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (graph, pipeline, documents, text, reports, pages, checks, ledgers, articles, streams):
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)
