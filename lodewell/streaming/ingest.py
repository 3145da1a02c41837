"""Incremental ingestion on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.operators.dedup import insert_ignore


def stream(spark: SparkSession, path: str, schema, max_files: int = 1_000) -> DataFrame:
    """New parquet files of a folder; the checkpoint is the high-water mark."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process what there is in micro-batches, then stop."""
    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_new(target: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends the first row of each key that the target lacks.

    Each micro-batch overwrites the folder of its own id, and anti-joins the key columns (and no others) of the
    folders of all others: a batch that runs again after a failure gives the same result. Where lateness is bounded,
    distinct_stream() keeps its state instead and reads nothing again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        root = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            names = [s.getPath().getName() for s in fs.listStatus(root)]
            others = [f"{target}/{n}" for n in names if n.startswith("batch=") and n != f"batch={batch_id}"]
            if others:
                seen = spark.read.schema(batch.select(*keys).schema).parquet(*others)
        new = insert_ignore(seen if seen is not None else batch.select(*keys).limit(0), batch, keys, order)
        new.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def distinct_stream(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark, with bounded state."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_budget(calls: DataFrame, source: str, time: str, limit: int) -> DataFrame:
    """For each source and UTC day: calls asked for, allowed and refused under a daily limit.

    Every call costs one, so what a running count allows is the smaller of the count and the limit: no window over a day's calls is needed.
    """
    by = calls.groupBy(F.col(source).alias("source"), F.to_date(time).alias("day")).agg(F.count("*").alias("asked"))
    return by.select("source", "day", "asked", F.least("asked", F.lit(limit).cast("long")).alias("allowed"), F.greatest(F.col("asked") - limit, F.lit(0).cast("long")).alias("refused"))


def allowed_calls(calls: DataFrame, source: str, time: str, order: list[str], cost: str, limit: int) -> DataFrame:
    """Each call with whether a daily budget allows it, where calls cost different amounts and a refused one is taken back.

    The decision depends on all earlier ones of the day, so a source's day is read in order by one task, in Arrow batches.
    """
    import pandas as pd

    keyed = calls.withColumn("__day", F.to_date(time))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + ", allowed boolean"

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, out = 0, []
        for c in pdf[cost]:
            ok = used + c <= limit
            used += c if ok else 0
            out.append(bool(ok))
        return pdf.drop(columns="__day").assign(allowed=out)

    return keyed.groupBy(source, "__day").applyInPandas(decide, schema)


def tumbling_counts(df: DataFrame, source: str, time: str, delay: str = "2 hours") -> DataFrame:
    """The streaming form of the daily counts: one day's window, state dropped after the delay."""
    return df.withWatermark(time, delay).groupBy(F.col(source).alias("source"), F.window(time, "1 day")).agg(F.count("*").alias("asked"))


