"""A posting feed in pages: a custom batch and streaming source over saved pages, with windows, caps and cycle guards."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "seq long, page string, url string, status string, business_name string, window_complete boolean"
#: Pages of one walk and items of a page.
MAX_PAGES, MAX_ITEMS = 32, 2000


def walk(folder: str, page: str | None, limit: int = MAX_PAGES) -> Iterator[tuple[str, dict, bool]]:
    """(name, body, whether the walk ended by itself) of saved pages from one on, by next_url; a cycle raises."""
    seen: set[str] = set()
    held = []
    while page and len(seen) < limit:
        if page in seen:
            raise ValueError("the feed's pages form a cycle")
        seen.add(page)
        with open(os.path.join(folder, f"{page}.json"), encoding="utf-8") as f:
            body = json.load(f)
        if len(body.get("items", [])) > MAX_ITEMS:
            raise ValueError("a feed page has too many items")
        held.append((page, body))
        page = body.get("next_url")
    for name, body in held:
        yield name, body, page is None


def rows(folder: str, page: str | None, seq: int = 0) -> Iterator[tuple]:
    for name, body, complete in walk(folder, page):
        for item in body.get("items", []):
            entry = item.get("_feed_entry") or {}
            yield seq, name, item.get("url"), entry.get("status"), entry.get("businessName"), complete
            seq += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # pages name their successors

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows(self.options["path"], self.options.get("first", "first"))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"page": self.options.get("first", "first"), "seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        path = self.options["path"]
        if not start["page"] or not os.path.exists(os.path.join(path, f"{start['page']}.json")):
            return iter(()), start
        found = list(rows(path, start["page"], start["seq"]))
        last = [x for x in walk(path, start["page"])][-1][1]
        return iter(found), {"page": last.get("next_url"), "seq": start["seq"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(r for r in rows(self.options["path"], start["page"], start["seq"]) if r[0] < end["seq"])


class PostingFeed(DataSource):
    """format `posting_feed`; options: path (a folder that all executors see), first (name of the first page)."""

    @classmethod
    def name(cls) -> str:
        return "posting_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))
