"""Spark data source over a paged fetch function supplied by the user, batch and streaming.

``fetch(page)`` returns the documents of a 1-based page. Reader ``i`` of ``n``
fetches pages i, i+n, i+2n … and stops at its first page that is not full:
nothing follows such a page. Together the readers see every page, at the cost
of one short or empty request each.

A ``ranged`` source is asked ``fetch(page, low, high)`` for the pages of the documents whose ``updated_at`` lies in
an inclusive range, either end None. A filter on the column ``updated_at`` becomes that range and is applied to the
rows again, so a service that answers with too much gives the same rows. Spark asks such a source only while
``spark.sql.python.filterPushdown.enabled`` is set; ``read_paged`` sets it.

A stream expects documents to be added at the end. Its offset is a page and the number of documents seen of it: a
short last page is fetched again once it has grown, and no document is given twice. The end is found by doubling
steps and bisection, so a trigger asks for a few pages on the driver, and the readers fetch the rest.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from entitylake.operators.pages import PAGE_SIZE

Fetch = Callable[..., list]

# Python workers get the readers with the data source and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Stride(InputPartition):
    """Pages first, first + step …; in a stream up to ``end`` and between two places, each a page and a number of documents."""

    def __init__(self, first: int, step: int, since: tuple[int, int] = (0, 0), until: tuple[int, int] | None = None) -> None:
        self.first, self.step, self.since, self.until = first, step, since, until


def _updated_at(document: object) -> int | None:
    value = document.get("updated_at") if isinstance(document, dict) else None
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _row(page: int, position: int, document: object) -> tuple:
    return page, position, _updated_at(document), json.dumps(document, ensure_ascii=False)


class _PageReader(DataSourceReader):
    def __init__(self, fetch: Fetch, first_page: int, page_size: int, readers: int) -> None:
        self.fetch = fetch
        self.first_page = first_page
        self.page_size = page_size
        self.readers = readers

    def asked(self, page: int) -> list:
        return self.fetch(page)

    def partitions(self) -> list[InputPartition]:
        return [_Stride(self.first_page + i, self.readers) for i in range(self.readers)]

    def read(self, partition: _Stride) -> Iterator[tuple]:
        page = partition.first
        while True:
            documents = self.asked(page)
            for position, document in enumerate(documents):
                yield _row(page, position, document)
            if len(documents) != self.page_size:
                return
            page += partition.step


class _RangedReader(_PageReader):
    low: int | None = None
    high: int | None = None

    def asked(self, page: int) -> list:
        return self.fetch(page, self.low, self.high)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the range by each comparison of ``updated_at`` and leaves all filters to be applied to the rows too."""
        for f in filters:
            if getattr(f, "attribute", None) != ("updated_at",) or not isinstance(getattr(f, "value", None), int):
                continue
            low = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f))
            high = {EqualTo: f.value, LessThanOrEqual: f.value, LessThan: f.value - 1}.get(type(f))
            self.low = max((x for x in (self.low, low) if x is not None), default=None)
            self.high = min((x for x in (self.high, high) if x is not None), default=None)
        return filters


class _PageStream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, first_page: int, page_size: int, readers: int) -> None:
        self.fetch, self.first_page, self.page_size, self.readers = fetch, first_page, page_size, readers
        self.full = first_page - 1

    def initialOffset(self) -> dict:
        return {"page": self.first_page, "seen": 0}

    def latestOffset(self) -> dict:
        """The first page that is not full and how many documents it has."""
        sizes: dict[int, int] = {}

        def size(page: int) -> int:
            if page not in sizes:
                sizes[page] = len(self.fetch(page))
            return sizes[page]

        step = 1
        while size(self.full + step) == self.page_size:
            self.full += step
            step *= 2
        short = self.full + step
        while short - self.full > 1:
            middle = (self.full + short) // 2
            if size(middle) == self.page_size:
                self.full = middle
            else:
                short = middle
        return {"page": short, "seen": size(short)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = (start["page"], start["seen"]), (end["page"], end["seen"])
        last = until[0] if until[1] else until[0] - 1
        readers = min(self.readers, last - since[0] + 1)
        return [_Stride(since[0] + i, readers, since, until) for i in range(readers)]

    def read(self, partition: _Stride) -> Iterator[tuple]:
        for page in range(partition.first, partition.until[0] + 1, partition.step):
            if (page, 0) == partition.until:
                return
            for position, document in enumerate(self.fetch(page)):
                if partition.since <= (page, position) < partition.until:
                    yield _row(page, position, document)


def paged_source(name: str, fetch: Fetch, ranged: bool = False) -> type[DataSource]:
    """Data source class ``name``; register it with ``spark.dataSource.register``."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page bigint, pos int, updated_at bigint, json string"

        def _how(self) -> tuple[int, int, int]:
            o = self.options
            return int(o.get("firstPage", 1)), int(o.get("pageSize", PAGE_SIZE)), int(o.get("readers", 1))

        def reader(self, schema) -> DataSourceReader:
            return (_RangedReader if ranged else _PageReader)(fetch, *self._how())

        def streamReader(self, schema) -> DataSourceStreamReader:
            every = (lambda page: fetch(page, None, None)) if ranged else fetch
            return _PageStream(every, *self._how())

    PagedSource.ranged = ranged
    return PagedSource


def _documents(rows: DataFrame, entity: str) -> DataFrame:
    return rows.select(F.lit(entity).alias("entity"), "page", "pos", "updated_at", F.parse_json("json").alias("doc"))


def _options(spark: SparkSession, options: dict[str, object]) -> dict[str, object]:
    return {"readers": spark.sparkContext.defaultParallelism, **options}


def read_paged(spark: SparkSession, source: type[DataSource], entity: str, **options: object) -> DataFrame:
    """(entity, page, pos, updated_at, doc) of all pages, by as many readers as the session has cores unless told otherwise.

    ``updated_at`` is the document's own where that is a number. ``filters.updated_range`` on it reaches a ranged source.
    """
    if source.ranged:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).options(**_options(spark, options)).load()
    # Spark keeps the pushed reader of a frame for its later scans unless they push a filter too, so each one has a filter.
    return _documents(rows.filter("page >= 0") if source.ranged else rows, entity)


def stream_paged(spark: SparkSession, source: type[DataSource], entity: str, **options: object) -> DataFrame:
    """The same as a stream that goes on behind the last document it has seen."""
    spark.dataSource.register(source)
    return _documents(spark.readStream.format(source.name()).options(**_options(spark, options)).load(), entity)
