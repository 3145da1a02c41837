"""The raw layer: pending scans, marking, resets. Runs are in ingestion.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.hashing import content_hash, scrub_pii

RAW_KEY = ["source", "source_id", "content_hash"]


def documents(rows: DataFrame) -> DataFrame:
    """(source, source_id, endpoint, payload) with personal data out and content_hash; so hashes never depend on it."""
    return rows.withColumn("payload", scrub_pii(F.col("payload"))).withColumn("content_hash", content_hash(F.col("payload")))


def list_and_details(lists: DataFrame, details: DataFrame, key: str = "source_id") -> DataFrame:
    """List rows, and for those whose key details have, a detail row: one union with `endpoint`, instead of a lookup for each row. Both sides have the same columns."""
    enriched = details.join(lists.select(key).distinct(), key, "left_semi").select(*lists.columns)
    return lists.withColumn("endpoint", F.lit("list")).unionByName(enriched.withColumn("endpoint", F.lit("detail")))


def pending(raw: DataFrame, source: str, limit: int = 5_000, endpoint: str = "detail") -> DataFrame:
    """The oldest unprocessed rows: a top-n scan of four columns, ties by id."""
    mine = (F.col("source") == source) & (F.col("endpoint") == endpoint) & F.col("processed_at").isNull()
    return raw.where(mine).select("id", "source_id", "payload", "fetched_at").orderBy("fetched_at", "id").limit(limit)


def mark_processed(raw: DataFrame, source: str, keys: DataFrame, at: Column, by: str = "source_id") -> DataFrame:
    """raw with processed_at set on every row of the source whose `by` is among keys: all versions and endpoints of a source_id, or single rows by id."""
    done = keys.select(F.col(by).alias("__done")).distinct()
    joined = raw.join(done, F.col(by) == F.col("__done"), "left")
    hit = F.col("__done").isNotNull() & (F.col("source") == source)
    return joined.withColumn("processed_at", F.when(hit, at).otherwise(F.col("processed_at"))).select(*raw.columns)


def reset(raw: DataFrame, source: str) -> DataFrame:
    """The source's rows are pending again."""
    return raw.withColumn("processed_at", F.when(F.col("source") == source, F.lit(None)).otherwise(F.col("processed_at")))


class BudgetExceeded(RuntimeError):
    def __init__(self, source: str, limit: int, used: int):
        super().__init__(f"{source}: {used} of {limit} calls used")
        self.source, self.limit, self.used = source, limit, used
