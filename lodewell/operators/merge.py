"""Upserts as pure functions of two DataFrames: the merged table with an `action` for each row, and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.session import shared_dir

ACTIONS = ("insert", "update", "skip")


def merge(target: DataFrame, source: DataFrame, keys: list[str], *, hash_column: str | None = None, insert_only: tuple[str, ...] = ()) -> DataFrame:
    """target with source merged in by unique keys, and `action`: insert, update, skip, or null for rows that only target has.

    A matched row takes the source's columns, nulls too. With hash_column, only where the hashes differ (null-safe);
    equal hashes skip the row, so a change outside the hashed columns alone never updates. `insert_only` columns,
    and target columns that the source lacks, keep their value in an update. One full outer join on the keys.
    """
    # `there` flags tell a missing row from a null value
    t = target.select(*[F.col(c).alias(f"__t_{c}") for c in target.columns], F.lit(True).alias("__t_there"))
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns], F.lit(True).alias("__s_there"))
    on = [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys]
    both = t.join(s, on, "full_outer")
    old, new = F.col("__t_there").isNotNull(), F.col("__s_there").isNotNull()
    same = F.col(f"__t_{hash_column}").eqNullSafe(F.col(f"__s_{hash_column}")) if hash_column else F.lit(False)
    action = F.when(new & ~old, "insert").when(new & old & ~same, "update").when(new & old, "skip")

    def value(c: str):
        if c not in source.columns:
            return F.col(f"__t_{c}")
        take = (new & ~old) if c in insert_only else new & (~old | ~same)
        return F.when(take, F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}"))

    columns = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    return both.select(*[(value(c) if c in target.columns else F.col(f"__s_{c}")).alias(c) for c in columns], action.alias("action"))


def tally(merged: DataFrame) -> DataFrame:
    """inserted, updated, skipped in one row."""
    return merged.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in zip(ACTIONS, ("inserted", "updated", "skipped"), strict=True)])


def with_surrogate_ids(merged: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Ids for rows whose id is null: from the largest id on, in the order of the natural key.

    The new rows are dealt out by ranges of the key once and written to the shared folder, so that counts and
    numbers see the same ranges; each range is numbered by itself, from the sum of the counts before it.
    """
    spark = merged.sparkSession
    top = merged.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
    have, lack = merged.where(F.col(id_column).isNotNull()), merged.where(F.col(id_column).isNull())
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), shared_dir(spark)
    lack.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(lack.withColumn("__part", F.lit(0)).schema).parquet(path)
    starts, at = [], top
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect()):  # a row for each range
        starts.append((part, at))
        at += n
    if not starts:
        return merged
    base = F.broadcast(spark.createDataFrame(starts, "__part int, __base long"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = ranged.join(base, "__part").withColumn(id_column, F.col("__base") + number).select(*merged.columns)
    return have.unionByName(numbered)


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new versioned folder; what a plan reads is never overwritten."""
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """The rows that a delete leaves: those for which the predicate is not true."""
    return df.where(~F.coalesce(predicate, F.lit(False)))
