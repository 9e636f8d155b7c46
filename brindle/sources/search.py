"""A paged search as a Spark data source: a partition a planned query, a reader that stops early."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Planned(InputPartition):
    query: str


def pages(fetch, query: str, per_page: int = 100, limit: int | None = None, cap: int = 1000, attempts: int = 5, pause: float = 0.0, sleep=time.sleep) -> Iterator[dict]:
    """Pages of a query until the total, the limit or a short page ends it.

    fetch(query, page, per_page) gives {total, items}; transport errors are tried again with
    doubling waits of at most 8 seconds, other errors pass through.
    """
    per_page = max(1, min(per_page, 100))
    most = min(cap, limit) if limit is not None else cap
    seen, page = 0, 1
    while seen < most:
        for attempt in range(attempts):
            try:
                got = fetch(query, page, per_page)
                break
            except (ConnectionError, TimeoutError):
                if attempt == attempts - 1:
                    raise
                sleep(min(2**attempt, 8))
        target = min(most, got["total"])
        items = got["items"][: target - seen]
        seen += len(items)
        yield {"query": query, "page": page, "per_page": per_page, "total": got["total"], "target": target, "fetched": seen, "items": items}
        if not items or len(got["items"]) < per_page or seen >= target:
            return
        page += 1
        if pause:
            sleep(pause)


class _FromFile:
    """A recorded service: a JSON file of {query: [item, ...]}, for use without a network."""

    def __init__(self, text: str):
        self.items = json.loads(text)

    def __call__(self, query: str, page: int, per_page: int) -> dict:
        found = self.items.get(query, [])
        return {"total": len(found), "items": found[(page - 1) * per_page : page * per_page]}


class SearchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        return [Planned(q) for q in json.loads(self.options["queries"])]

    def read(self, partition):
        fetch = _FromFile(self.options["recorded"])
        limit = self.options.get("limit")
        for page in pages(fetch, partition.query, int(self.options.get("per_page", 100)), int(limit) if limit else None):
            for item in page["items"]:
                yield tuple(item.get(f.name) if f.name != "source_query" else partition.query for f in self.schema)


class SearchSource(DataSource):
    """spark.read.format("paged_search"): options queries (JSON list), recorded, per_page, limit."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self):
        return "full_name string, stars long, language string, source_query string"

    def reader(self, schema):
        return SearchReader(schema, self.options)
