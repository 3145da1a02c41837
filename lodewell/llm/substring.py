"""Substring deduplication with difference-cover anchors (operator 6).

A window is `window` consecutive words of a document. Positions modulo PERIOD that lie in a difference cover are
anchors: for any two positions some shift below PERIOD takes both into the cover, so two equal windows share an
anchor at the same place of both. Anchors hash window - PERIOD + 1 words, which fit in the windows after any
such shift. Three passes, none of which gathers a group of copies:

1. Hash the anchors (a quarter of all positions) and find those whose hash occurs more than once.
2. Extend: only windows that hold such an anchor can repeat. Hash those whole (128 bits) and find the ones that
   occur more than once.
3. Remove the words that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodewell.llm.common import WORDS, chunks, drop, release, stored, table
from lodewell.llm.repeats import Places, repeated
from lodewell.llm.words import WordHashes

WINDOW = 35
#: Perfect difference covers by period; every difference modulo the period occurs in them.
COVERS = {7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}


def cover_for(window: int) -> tuple[int, list[int]]:
    """The longest period whose anchors keep at least 15 words (or, of short windows, a third)."""
    least = min(15, max(1, window // 3))
    fit = [p for p in COVERS if window - p + 1 >= least]
    return (max(fit), COVERS[max(fit)]) if fit else (1, [0])


def anchors(window: int):
    period, cover = cover_for(window)
    size = window - period + 1
    in_cover = np.zeros(period, bool)
    in_cover[cover] = True

    def places(batch: pa.RecordBatch) -> Places:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, texts in chunks(batch.column(2).to_pylist()):
            words = WordHashes(texts)
            for i, (start, end) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                if end - start >= window:
                    pos = np.arange(end - start - size + 1)
                    pos = pos[in_cover[pos % period]]
                    yield a[first + i], b[first + i], pos, words.windows(start + pos, size, 1)

    return places


def candidates(window: int):
    period, _ = cover_for(window)

    def places(batch: pa.RecordBatch) -> Places:
        a, b, found = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for first, texts in chunks(batch.column(2).to_pylist()):
            words = WordHashes(texts)
            for i, (start, end) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                n = end - start - window + 1
                if n > 0:
                    anchor = np.frombuffer(found[first + i], "<i4").astype(np.int64)
                    change = np.zeros(end - start + 1, np.int64)
                    np.add.at(change, np.maximum(0, anchor - period + 1), 1)
                    np.add.at(change, anchor + 1, -1)
                    pos = np.flatnonzero(np.cumsum(change)[:n])
                    yield a[first + i], b[first + i], pos, words.windows(start + pos, window)

    return places


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two ids of the row: equal for rows of equal doc_id and text only."""
    return docs.withColumn("__lw_a", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn("__lw_b", F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__lw_a, __lw_b, starts): for every document with a window that also starts elsewhere, the packed starts of all such windows."""
    spark = docs.sparkSession
    rows = keyed(docs).select("__lw_a", "__lw_b", "text").where("text IS NOT NULL")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shared = stored(repeated(rows, anchors(window), chars / 24))
    release(spark)
    held = rows.join(shared, ["__lw_a", "__lw_b"]).select("__lw_a", "__lw_b", "text", "positions")
    starts = stored(repeated(held, candidates(window), chars / 24))
    release(spark)
    drop(shared)
    return starts.withColumnRenamed("positions", "__lw_starts")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs' columns, then __lw_words, __lw_removed and __lw_kept: the words that no repeated window covers, joined by one space.

    Every occurrence goes, the first too, and windows are judged on the input. A null or empty text has no words
    and keeps the empty text. Repeated rows are copies of each other. Texts of fewer words than the window keep all.
    Only texts and packed positions are shuffled, by document.
    """
    keys = ["__lw_a", "__lw_b"]
    joined = keyed(docs).join(repeats(docs, window), keys, "left").drop(*keys)
    text, found = joined.columns.index("text"), joined.columns.index("__lw_starts")
    shape = StructType([*[f for f in joined.schema.fields if f.name != "__lw_starts"], StructField("__lw_words", LongType()), StructField("__lw_removed", LongType()), StructField("__lw_kept", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(text).to_pylist()):
                part = batch.slice(first, len(texts))
                totals, removed, kept = [], [], []
                for t, starts in zip(texts, part.column(found).to_pylist(), strict=True):
                    words = WORDS.findall(t)
                    totals.append(len(words))
                    if starts:
                        at = np.frombuffer(starts, "<i4")
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                        stay = np.cumsum(change)[:-1] == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    removed.append(totals[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != found], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=shape.names)

    return joined.mapInArrow(run, shape)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of `documents` that windows of 35 words which start elsewhere too do not cover; see remove.

    A null text has no words. Repeated rows, whatever their ids, are each other's repeats. Other columns are ignored;
    an empty table gives no rows.
    """
    done = remove(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")))
    return done.select("doc_id", F.col("__lw_words").alias("n_words"), F.col("__lw_removed").alias("n_removed"), F.sha2("__lw_kept", 256).alias("kept_sha256"))


