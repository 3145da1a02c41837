"""Helpers that the training-data operators share: storage that every executor sees, and batching."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.session import shared_dir as shared_dir

#: Code points that the Python kernels take at once.
BATCH_CHARS = 1 << 20
#: Words: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)
#: A-Z to a-z, and nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodewell_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_lodewell_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, for Python code on the driver or an executor."""
    uri = re.sub(r"^file:/+", "file:///", uri) if uri.startswith("file:") else uri
    return pafs.FileSystem.from_uri(uri)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def chunks(texts: Iterable, limit: int = BATCH_CHARS) -> Iterator[tuple[int, list]]:
    """(index of the first, texts) in runs of about `limit` code points (of texts as bytes: bytes); None becomes the empty text."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t := t or "")
        size += len(t)
        if size >= limit:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
