"""Tables by fixed schema: creation, removal, defaults, the lifecycle of postings, and a layout for frequent filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodewell.schemas import DEFAULTS, TABLES


def create_tables(spark: SparkSession, database: str, names: list[str] | None = None) -> None:
    """The tables of the schema as empty parquet tables of a database; existing ones stay."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in names or TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({TABLES[name]}) USING parquet")


def drop_tables(spark: SparkSession, database: str, names: list[str] | None = None) -> None:
    for name in reversed(names or list(TABLES)):
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def with_defaults(rows: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """rows with every column of the table, in its order: columns that rows lack have the default, or null without one.

    A column that is there keeps its nulls, as an explicit null does in an insert. `now` stands for the time of the
    statement; it belongs to no hash.
    """
    schema = rows.sparkSession.createDataFrame([], TABLES[table]).schema
    known = DEFAULTS.get(table, {})

    def fill(name: str, kind) -> Column:
        value = known.get(name)
        if value == "now":
            value = F.current_timestamp() if now is None else now
        elif isinstance(kind, ArrayType) and value is not None:
            value = F.array(*map(F.lit, value))
        else:
            value = F.lit(value)
        return value.cast(kind)

    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else fill(f.name, f.dataType)).alias(f.name) for f in schema.fields])


def expire(jobs: DataFrame, today: Column) -> DataFrame:
    """jobs whose open postings are `expired` once their deadline has passed; none without a deadline, and no closed one."""
    over = (F.col("status") == "open") & (F.col("deadline") < today)
    return jobs.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def find_jobs(jobs: DataFrame, *, status: str | None = None, until: Column | None = None, region: str | None = None, category: str | None = None, years: int | None = None) -> DataFrame:
    """Postings by the usual conditions, all of which reach the scan: status, a deadline not before `until` (or none), region, category, and years that lie within the experience asked for (an open end is no limit)."""
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    if until is not None:
        jobs = jobs.where(F.col("deadline").isNull() | (F.col("deadline") >= until))
    if region is not None:
        jobs = jobs.where(F.col("region_code") == region)
    if category is not None:
        jobs = jobs.where(F.col("job_category") == category)
    if years is not None:
        jobs = jobs.where((F.coalesce("exp_min", F.lit(0)) <= years) & (F.col("exp_max").isNull() | (F.col("exp_max") >= years)))
    return jobs


def write_layout(jobs: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """A layout for find_jobs(): folders by status, files sorted by region, category and deadline, so that partitions and row-group statistics prune."""
    order = ["region_code", "job_category", "deadline"]
    ranged = jobs.repartitionByRange(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "status", *order)
    ranged.sortWithinPartitions("status", *order).write.partitionBy("status").option("maxRecordsPerFile", rows_a_file).parquet(path)
