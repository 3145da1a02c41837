"""Ingestion runs: a run table that only grows, and a loop that stores pages flush by flush."""

from __future__ import annotations

import json
import traceback
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.operators.dedup import insert_ignore, keep_last
from lodewell.operators.raw import RAW_KEY, BudgetExceeded, documents
from lodewell.schemas import RUN
from lodewell.session import shared_dir
from lodewell.sources.paged import CallBudget, ListQuery, PageSource, plan_pages

STORED = "source STRING, source_id STRING, endpoint STRING, payload STRING, content_hash STRING, fetched_at TIMESTAMP, flush INT"


@dataclass
class Handle:
    """What a run counts while it goes on."""

    id: int
    fetched: int = 0
    inserted: int = 0
    api_calls: int = 0

    @property
    def duplicates(self) -> int:
        return self.fetched - self.inserted


class RunTable:
    """Runs as files that are only added to: one row when a run begins and one when it ends; the last row of an id is its state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """A row for each run, in the columns of RUN."""
        if not self._there():
            return self.spark.createDataFrame([], RUN)
        every = self.spark.read.schema(RUN).parquet(self.path)
        return keep_last(every.withColumn("__over", F.col("finished_at").isNotNull()), ["id"], ["__over", "finished_at"]).drop("__over")

    def latest(self, source: str | None = None) -> DataFrame:
        """The run of the largest id, or no row."""
        runs = self.rows()
        return (runs if source is None else runs.where(F.col("source") == source)).orderBy(F.desc("id")).limit(1)

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _put(self, row: tuple) -> None:
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def run(self, source: str) -> Iterator[Handle]:
        """Logs a run: success, budget (calls used up) or failed, with what went wrong; it is always closed and an error always goes on."""
        started = datetime.now(UTC)
        handle = Handle((self.rows().agg(F.max("id")).first()[0] or 0) + 1)
        self._put((handle.id, source, "running", started, None, 0, 0, 0, 0, None))
        status, detail = "success", None
        try:
            yield handle
        except BudgetExceeded as e:
            status, detail = "budget", {"message": str(e), "limit": e.limit}
            raise
        except Exception as e:
            status, detail = "failed", {"type": type(e).__name__, "message": str(e), "trace": traceback.format_exc()[-2000:]}
            raise
        finally:
            self._put((handle.id, source, status, started, datetime.now(UTC), handle.api_calls, handle.fetched, handle.inserted, int(status != "success"), json.dumps(detail, ensure_ascii=False) if detail else None))


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """What is stored so far: one folder for each run's flush."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(STORED).parquet(f"{path}/*/*") if there else spark.createDataFrame([], STORED)


def fetched(spark: SparkSession, source: PageSource, pages: list[int], size: int, with_detail: bool) -> DataFrame:
    """(source, source_id, endpoint, payload, fetched_at): the pages' rows, each followed by its detail where there is one. Pages are read by the executors."""
    name, calls = source.name, source

    def read(rows: Iterator) -> Iterator:
        import pandas as pd

        for frame in rows:
            for page in frame["page"].tolist():
                out = []
                for source_id, payload in calls.page(page, size):
                    out.append((name, source_id, "list", payload))
                    if with_detail and calls.supports_detail and (detail := calls.detail(source_id)) is not None:
                        out.append((name, source_id, "detail", detail))
                yield pd.DataFrame(out, columns=["source", "source_id", "endpoint", "payload"])

    numbers = spark.createDataFrame([(p,) for p in pages], "page int").repartition(max(1, len(pages)), "page")
    return numbers.mapInPandas(read, "source string, source_id string, endpoint string, payload string").withColumn("fetched_at", F.current_timestamp())


def run_ingestion(spark: SparkSession, source: PageSource, query: ListQuery, runs: RunTable, path: str, *, budget: CallBudget | None = None, with_detail: bool = True, batch_size: int = 200) -> Handle:
    """Read the pages of a source into the raw layer at `path`, flush by flush; returns the run's counters.

    A flush is as many pages as hold batch_size rows. It adds the rows whose (source, source_id, content_hash) is not
    stored yet, so a run that is repeated adds none. Each page and each detail costs a call of the budget; where it is
    used up, flushes before stay, the one under way is lost, the run ends as `budget` and the error goes on.
    """
    size = query.size(source)
    each = max(1, batch_size // (size * (2 if with_detail else 1)))
    with runs.run(source.name) as handle:
        pages = plan_pages(source, query)
        for flush, x in enumerate(range(0, len(pages), each)):
            for page in pages[x : x + each]:
                rows = min(size, max(0, source.total() - (page - 1) * size))
                cost = 1 + (rows if with_detail and source.supports_detail else 0)
                if budget:
                    budget.consume(source.name, cost)
                handle.api_calls += cost
            store(spark, fetched(spark, source, pages[x : x + each], size, with_detail), path, handle, flush)
        return handle


def store(spark: SparkSession, rows: DataFrame, path: str, handle: Handle, flush: int) -> None:
    """Write a flush once, then count it from its own file."""
    kept = shared_dir(spark)
    documents(rows).withColumn("flush", F.lit(flush)).write.parquet(kept)
    incoming = spark.read.schema(STORED).parquet(kept)
    new = insert_ignore(raw_rows(spark, path), incoming, RAW_KEY, ["endpoint"])
    new.write.mode("overwrite").parquet(f"{path}/run={handle.id}/flush={flush}")
    handle.fetched += incoming.count()
    handle.inserted += spark.read.schema(STORED).parquet(f"{path}/run={handle.id}/flush={flush}").count()
