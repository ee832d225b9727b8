"""A small registry: a query and, where SQL can express it, its SQL."""

from __future__ import annotations


def registry():
    """(queries, sql, decorator)."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query
