"""Paged sources behind Spark's Python data source API: a page is a partition, a call budget is kept while pages are planned.

    PagedSource.register(spark, "postings", lambda options: MySource())
    spark.read.format("postings").option("pageSize", 100).option("maxPages", 10).load()
"""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from lodewell.operators.raw import BudgetExceeded
from lodewell.schemas import PII_KEYS

SCHEMA = "source_id string, payload string"


class PageSource(ABC):
    """A source of (source_id, payload) rows in pages; it is pickled to executors."""

    name = "source"
    max_page_size = 100
    supports_detail = True

    @abstractmethod
    def total(self) -> int: ...

    @abstractmethod
    def page(self, number: int, size: int) -> list[tuple[str, str]]:
        """Rows of a page, counted from 1."""

    def detail(self, source_id: str) -> str | None:
        return None

    def select(self, query: ListQuery) -> PageSource:
        """The source that answers a query's conditions; one that cannot filter is itself."""
        return self


@dataclass(frozen=True)
class RawDocument:
    """The only form in which a document goes on: personal data is out, and `content_hash` is of what is left."""

    source: str
    source_id: str
    endpoint: str
    payload: dict

    @classmethod
    def of(cls, source: str, source_id: str, endpoint: str, text: str) -> RawDocument:
        gone = frozenset(PII_KEYS)
        return cls(source, source_id, endpoint, json.loads(text, object_pairs_hook=lambda pairs: dict(p for p in pairs if p[0] not in gone)))

    @property
    def content_hash(self) -> str:
        text = json.dumps(self.payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class ListQuery:
    """A scan: its conditions, which a source may answer (see PageSource.select), and its pages."""

    page: int = 1
    page_size: int = 100
    max_pages: int = 1_000
    job_categories: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    keyword: str | None = None
    published_from: date | None = None
    published_to: date | None = None

    @classmethod
    def of(cls, options: dict) -> ListQuery:
        """From a reader's options: page, pageSize, maxPages, categories and regions (by commas), keyword, publishedFrom, publishedTo (ISO dates)."""
        o = {k.lower(): v for k, v in options.items()}
        many = lambda k: tuple(x.strip() for x in o.get(k, "").split(",") if x.strip())
        day = lambda k: date.fromisoformat(o[k]) if o.get(k) else None
        return cls(int(o.get("page", 1)), int(o.get("pagesize", 100)), int(o.get("maxpages", 1_000)), many("categories"), many("regions"), o.get("keyword"), day("publishedfrom"), day("publishedto"))

    def size(self, source: PageSource) -> int:
        return max(1, min(self.page_size, source.max_page_size))


def has_next(page: int, size: int, total: int) -> bool:
    return page * size < total


class CallBudget:
    """Calls a source may make in a UTC day; a call beyond the limit is taken back and refused. No limit counts only."""

    def __init__(self, limit: int | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.limit, self.clock, self.counts = limit, clock, {}

    def key(self, source: str) -> tuple[str, str]:
        return source, self.clock().strftime("%Y%m%d")

    def used(self, source: str) -> int:
        return self.counts.get(self.key(source), 0)

    def consume(self, source: str, n: int = 1) -> None:
        used = self.used(source)
        if self.limit is not None and used + n > self.limit:
            raise BudgetExceeded(source, self.limit, used)
        today = self.key(source)
        self.counts = {k: v for k, v in self.counts.items() if k[1] == today[1]} | {today: used + n}


def plan_pages(source: PageSource, query: ListQuery, budget: CallBudget | None = None) -> list[int]:
    """The pages from query.page on, one budget call each, until there is no next one or max_pages."""
    size, total, pages = query.size(source), source.total(), []
    number = query.page
    while len(pages) < query.max_pages and (number - 1) * size < total:
        if budget:
            budget.consume(source.name)
        pages.append(number)
        if not has_next(number, size, total):
            break
        number += 1
    return pages


def fetch_detail(source: PageSource, source_id: str, budget: CallBudget | None = None) -> RawDocument | None:
    """The detail of one id for a call of the budget; None where the source has no details (no call then) or not this id."""
    if not source.supports_detail:
        return None
    if budget:
        budget.consume(source.name)
    text = source.detail(source_id)
    return None if text is None else RawDocument.of(source.name, source_id, "detail", text)


class Page(InputPartition):
    def __init__(self, number: int, source_id: str | None = None):
        super().__init__(number)
        self.number, self.source_id = number, source_id


class Reader(DataSourceReader):
    """Pages of a source."""

    def __init__(self, source: PageSource, query: ListQuery, budget: CallBudget | None):
        self.source, self.size, self.query, self.budget = source.select(query), query.size(source), query, budget
        self.wanted: str | None = None

    def partitions(self) -> list[InputPartition]:
        if self.wanted is not None:
            if self.budget:
                self.budget.consume(self.source.name)
            found = [Page(0, self.wanted)]
        else:
            found = [Page(n) for n in plan_pages(self.source, self.query, self.budget)] or [Page(0)]
        self.budget = None  # the clock of a budget stays on the driver
        return found

    def read(self, partition: Page) -> Iterator[tuple[str, str]]:
        if partition.number:
            yield from self.source.page(partition.number, self.size)
        elif partition.source_id is not None and (text := self.source.detail(partition.source_id)) is not None:
            yield partition.source_id, text


class LookupReader(Reader):
    """By a pushed `source_id = ...`, the detail of that id alone. Needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source_id",) and self.wanted is None and self.source.supports_detail:
                self.wanted = f.value
            else:
                yield f


class PagedSource:
    """Registers a source. Options: those of ListQuery.of, and lookups=true for LookupReader."""

    @staticmethod
    def register(spark: SparkSession, name: str, make: Callable[[dict], PageSource], budget: CallBudget | None = None) -> None:
        class Bound(DataSource):
            @classmethod
            def name(cls) -> str:
                return name

            def schema(self) -> str:
                return SCHEMA

            def reader(self, schema) -> DataSourceReader:
                options = dict(self.options)
                kind = LookupReader if str(options.get("lookups", "")).lower() == "true" else Reader
                return kind(make(options), ListQuery.of(options), budget)

        spark.dataSource.register(Bound)
