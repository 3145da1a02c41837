"""Quality metrics and constraint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column_name, fill_rate): one pass over the data; an empty text counts as filled, an empty table gives no rows."""
    columns = columns or df.columns
    rates = [F.round(1 - F.count_if(F.col(c).isNull()) / F.nullif(F.count("*"), F.lit(0)), 4) for c in columns]
    wide = df.agg(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), r.alias("fill_rate")) for i, (c, r) in enumerate(zip(columns, rates, strict=True))]).alias("x"))
    return wide.select(F.explode("x").alias("x")).select("x.*").where(F.col("fill_rate").isNotNull())


def least_filled(df: DataFrame, n: int = 5) -> DataFrame:
    return fill_rate(df).orderBy("fill_rate", "position").limit(n).select("column_name", "fill_rate")


def parse_success(df: DataFrame, notes: dict[str, Column]) -> DataFrame:
    """(field, total, parsed, success_rate) by the notes that parsers left."""
    rows = [F.struct(F.lit(k).alias("field"), F.count("*").alias("total"), F.count_if(v.isNull()).alias("parsed")) for k, v in notes.items()]
    out = df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("success_rate", F.round(F.col("parsed") / F.nullif(F.col("total"), F.lit(0)), 4))


def check_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations) of checks that a row passes unless they are false (null passes)."""
    rows = [F.struct(F.lit(k).alias("check_name"), F.count_if(~F.coalesce(v, F.lit(True))).alias("violations")) for k, v in checks.items()]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def violating(df: DataFrame, check: Column) -> DataFrame:
    return df.where(~F.coalesce(check, F.lit(True)))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, without nulls, that occur more than once, and how often."""
    there = df.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    return there.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans_to_null(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """A foreign key whose parent is gone becomes null."""
    there = parent.select(F.col(parent_key).alias("__parent")).distinct()
    return child.join(there, child[key] == there["__parent"], "left").withColumn(key, F.col("__parent")).select(*child.columns)


def cascade(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Only children whose parent is there."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
