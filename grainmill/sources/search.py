"""Paged web searches as a Spark data source; the caller brings the function that fetches a page."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100
PAUSE_SECONDS = 2.0


@dataclass(frozen=True)
class Page:
    """One answer: a status code, the items, and the seconds to wait that a refusal names."""

    status: int
    items: tuple[str, ...] = ()
    retry_after: float = 0.0


Fetch = Callable[[str, int, int], Page]


def paged(fetch: Fetch, query: str, pause: float = PAUSE_SECONDS, page_size: int = PAGE, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Items of all pages, each once, in order of first arrival.

    Pages are asked for one at a time with a pause between them.  A refusal
    (403) is tried once more after the time it names.  An error, an empty page or
    a short one ends the search.
    """
    seen: set[str] = set()
    page = 0
    while True:
        if page:
            sleep(pause)
        page += 1
        answer = fetch(query, page, page_size)
        if answer.status == 403:
            sleep(answer.retry_after)
            answer = fetch(query, page, page_size)
        if answer.status != 200:
            return
        for item in answer.items:
            if item not in seen:
                seen.add(item)
                yield item
        if len(answer.items) < page_size:
            return


def register_search(spark: SparkSession, name: str, fetch: Fetch, pause: float = PAUSE_SECONDS) -> None:
    """Makes ``spark.read.format(name).option("query", ...)`` a search; several queries, one a line, run as partitions."""

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "query string, arrival long, item string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["query"].splitlines())

    class Reader(DataSourceReader):
        def __init__(self, queries: list[str]):
            self.queries = queries

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(q) for q in self.queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for i, item in enumerate(paged(fetch, partition.value, pause)):
                yield partition.value, i, item

    spark.dataSource.register(Search)
