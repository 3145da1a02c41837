"""Loading of normalised postings: companies first, then postings with their companies' ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.hashing import CONTENT_FIELDS, row_hash
from lodewell.operators.dedup import keep_first
from lodewell.operators.merge import merge, tally, with_surrogate_ids
from lodewell.operators.normalize import attach_company
from lodewell.operators.skills import validate
from lodewell.schemas import COMPANY

COMPANY_KEY, JOB_KEY = ["name_normalized"], ["source", "source_id"]


def as_text(jobs: DataFrame) -> DataFrame:
    """jobs with sections as JSON text, the form in which they are hashed."""
    return jobs.withColumn("sections", F.to_json("sections", {"ignoreNullFields": "false"})) if not dict(jobs.dtypes)["sections"] == "string" else jobs


def company_rows(companies: DataFrame) -> DataFrame:
    """A company's five attributes by the names of its table; registration number and industry code are not known yet."""
    return companies.select(F.col("company_name").alias("name"), F.col("company_name_normalized").alias("name_normalized"), F.lit(None).cast("string").alias("biz_no"), F.lit(None).cast("string").alias("industry_code"), "industry_name", "size_category", "homepage")


def upsert_companies(target: DataFrame, companies: DataFrame) -> DataFrame:
    """target (columns of COMPANY) with companies merged in by key: the last writer wins, nulls too; new ones get ids in the order of their keys."""
    rows = company_rows(companies).drop("biz_no", "industry_code")  # these stay as they are
    merged = merge(target, rows, COMPANY_KEY).drop("action")
    return with_surrogate_ids(merged, "id", COMPANY_KEY)


def job_rows(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings as rows of their table: key, company_id (null if unknown), the content fields, parse_flags and content_hash. The hash covers the content fields only, dates as ISO texts and nulls included, so a change of company alone is none."""
    texts = as_text(jobs)
    hashed = attach_company(texts, companies).withColumn("content_hash", row_hash())
    flags = ["parse_flags"] if "parse_flags" in jobs.columns else []
    return hashed.select(*JOB_KEY, "company_id", *CONTENT_FIELDS, *flags, "content_hash")


def upsert_jobs(target: DataFrame, rows: DataFrame) -> DataFrame:
    """target with rows merged in by key where their content_hash is another, and `action`; parse_flags are written at the insert only."""
    return merge(target, rows, JOB_KEY, hash_column="content_hash", insert_only=("parse_flags",))


@dataclass(frozen=True)
class Loaded:
    companies: DataFrame
    #: With `action`.
    jobs: DataFrame
    #: companies (keys that were resolved, not new ones), inserted, updated, skipped: one row.
    result: DataFrame


def load_normalized(target_companies: DataFrame, target_jobs: DataFrame, jobs: DataFrame, companies: DataFrame) -> Loaded:
    """Merge companies, then postings, whose company ids come from the merged companies. Nothing is cut into batches: one plan loads all."""
    loaded = upsert_companies(target_companies, companies)
    merged = upsert_jobs(target_jobs, job_rows(jobs, loaded))
    resolved = loaded.join(companies.select(F.col("company_name_normalized").alias("name_normalized")).distinct(), COMPANY_KEY, "left_semi")
    counts = tally(merged).crossJoin(F.broadcast(resolved.agg(F.count("*").alias("companies"))))  # two rows of one
    return Loaded(loaded, merged, counts.select("companies", "inserted", "updated", "skipped"))


def no_companies(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], COMPANY)


def seed_skills(target: DataFrame, rows: DataFrame) -> DataFrame:
    """A skill table (canonical_name, category, aliases, match_patterns, is_active) with dictionary rows (name, category, aliases, match_patterns) merged in.

    Known names are overwritten and become active; missing aliases are an empty list. A dictionary with any problem
    (see skills.validate) is refused as a whole, with a ValueError that names up to 20 of them.
    """
    problems = validate(rows).orderBy("problem", "name").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem}: {p.name}" for p in problems))
    none: Column = F.array().cast("array<string>")
    new = rows.select(F.col("name").alias("canonical_name"), "category", F.coalesce("aliases", none).alias("aliases"), "match_patterns", F.lit(True).alias("is_active"))
    return merge(target, keep_first(new, ["canonical_name"], ["canonical_name"]), ["canonical_name"])
