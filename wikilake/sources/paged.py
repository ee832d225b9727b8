"""A paged source of bookmarks: an API, or files in its form, that gives its items page by page.

    spark.dataSource.register(Paged)
    spark.read.format("paged").option("url", "https://api.example.org/items?page={page}").load()

The url has {page}, from 0; it is fetched over http(s), with a bearer token from `tokenFile` if that is given, or read from a file or from
all files of a folder (file: or a plain path, which all machines must see).  A page is an object with `items` and, as a rule, `count`,
the number of all items; items come in the order in which they were made, so only the last page grows.  In batch each page is a
partition.  As a stream an offset counts items, so a page that has grown is read again, but only its new items are given.  A page that is
broken or shorter than the count says fails the batch; the stream goes on from its checkpoint, and each item comes once."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "bookmark_id long, title string, link string, created string, collection_id long, tags array<string>"
PAGE_SIZE, RETRIES, PATIENCE = 50, 3, 1.0


class Part(InputPartition):
    """Items from begin on, below end; to the end of all pages if end is negative."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class Pages:
    """What both readers do: fetch a page, count items, give rows."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}  # names of options have no case
        self.url, self.size = given["url"], int(given.get("pagesize", PAGE_SIZE))
        self.token_file, self.retries = given.get("tokenfile"), int(given.get("retries", RETRIES))

    def fetch(self, page: int) -> dict:
        url = self.url.replace("{page}", str(page))
        if urlparse(url).scheme in ("http", "https"):
            return json.loads(self._get(url))
        path = unquote(urlparse(url).path) if url.startswith("file:") else url
        if os.path.isdir(path):
            parts = [f"{path}/{name}" for name in sorted(os.listdir(path)) if name[0] not in "._"]
        elif os.path.exists(path):
            parts = [path]
        else:
            return {"items": []}
        text = ""
        for part in parts:
            with open(part, encoding="utf-8") as f:
                text += f.read()
        return json.loads(text)

    def _get(self, url: str) -> bytes:
        request = urllib.request.Request(url)
        if self.token_file:
            with open(self.token_file, encoding="utf-8") as f:
                request.add_header("Authorization", f"Bearer {f.read().strip()}")
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return answer.read()
            except OSError:
                if not left:
                    raise
                time.sleep(PATIENCE * (self.retries - left + 1))
        raise AssertionError

    def total(self) -> int | None:
        """The number of all items; None if the source doesn't say."""
        return self.fetch(0).get("count")

    def rows(self, begin: int, end: int) -> Iterator[tuple]:
        at = begin
        while end < 0 or at < end:
            page = at // self.size
            items = self.fetch(page)["items"]
            if end < 0 and not items:
                return
            want = self.size if end < 0 else min(end - page * self.size, self.size)
            if end >= 0 and len(items) < want:
                raise ValueError(f"page {page} has {len(items)} items, {want} were to come")
            for x in items[at - page * self.size : want]:
                yield x["_id"], x.get("title") or "", x.get("link") or "", x.get("created"), (x.get("collection") or {}).get("$id"), x.get("tags")
            if end < 0 and len(items) < self.size:
                return
            at = (page + 1) * self.size


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def partitions(self) -> list[Part]:
        n, size = self.pages.total(), self.pages.size
        return [Part(0, -1)] if n is None else [Part(k, min(n, k + size)) for k in range(0, n, size)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        return self.pages.rows(part.begin, part.end)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"items": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        n = self.pages.total()
        if n is None:
            raise ValueError("a stream needs a source that counts its items")
        return {"items": n}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        size, begin, stop = self.pages.size, start["items"], end["items"]
        edges = [begin, *range((begin // size + 1) * size, stop, size), stop]
        return [Part(a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def read(self, part: Part) -> Iterator[tuple]:
        return self.pages.rows(part.begin, part.end)

    def commit(self, end: dict) -> None:
        pass


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options))
