"""Keep-first, keep-last and insert-ignore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep(df, keys, [F.col(c).desc() for c in order])


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that an append adds: the first of each key among incoming that target lacks (a null in a key never conflicts with target)."""
    return keep_first(incoming, keys, order).join(target.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def insert_counts(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """fetched, inserted, duplicates of such an append, in one row."""
    added = insert_ignore(target, incoming, keys, order).agg(F.count("*").alias("inserted"))
    return incoming.agg(F.count("*").alias("fetched")).crossJoin(F.broadcast(added)).select("fetched", "inserted", (F.col("fetched") - F.col("inserted")).alias("duplicates"))
