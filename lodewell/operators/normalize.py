"""Raw payloads to contract-checked postings and companies, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions import parse
from lodewell.operators.dedup import keep_first, keep_last
from lodewell.schemas import DETAIL

ORDER = ["fetched_at", "id"]
COMPANY_COLUMNS = ("company_name", "company_name_normalized", "industry_name", "size_category", "homepage")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def flatten(raw: DataFrame) -> DataFrame:
    """(source, payload, fetched_at, id) to flat postings: 24 columns by fixed schema, then the order columns.

    Missing objects and keys are null. The contact object is not in the payload's schema and so never read.
    Payloads are parsed in a generator of one row, below which no filter on their fields is pushed: so they are made and
    parsed once, not once more for each mention of a field in a filter.
    """
    p, w, c = F.col("p"), F.col("p.wantedInfo"), F.col("p.corpInfo")
    read = raw.select("*", F.explode(F.array(F.from_json("payload", DETAIL))).alias("p"))
    pay, years, until = parse.salary(w["sal"], w["salTpCd"]), parse.experience(w["enterTpNm"], w["enterTpCd"]), parse.deadline(w["receiptCloseDt"])
    main, needs = parse.clean_text(w["jobCont"]), parse.clean_text(w["certificate"])
    likes = parse.clean_text(F.concat_ws("\n", filled(w["pfCond"]), filled(w["etcPfCond"])))
    parsed = read.select("source", *ORDER, "p", pay.alias("pay"), years.alias("years"), until.alias("until"), F.struct(main.alias("main_tasks"), needs.alias("requirements"), likes.alias("preferred")).alias("sections"))
    flags = F.struct(F.col("pay.note").alias("salary"), F.col("years.note").alias("experience"), F.col("until.note").alias("deadline"))
    any_flag = F.coalesce(F.col("pay.note"), F.col("years.note"), F.col("until.note")).isNotNull()
    parts = [filled(F.col(f"sections.{x}")) for x in ("main_tasks", "requirements", "preferred")]
    return parsed.select(
        "source",
        p["wantedAuthNo"].alias("source_id"),
        c["corpNm"].alias("company_name"),
        parse.company_key(c["corpNm"]).alias("company_name_normalized"),
        c["indTpCdNm"].alias("industry_name"),
        c["busiSize"].alias("size_category"),
        c["homePg"].alias("homepage"),
        w["wantedTitle"].alias("title"),
        filled(F.concat_ws("\n\n", *parts)).alias("description"),
        "sections",
        w["jobsNm"].alias("job_category"),
        parse.employment(w["empTpCd"]).alias("employment_type"),
        F.col("years.min").alias("exp_min"),
        F.col("years.max").alias("exp_max"),
        parse.education(w["minEdubgIcd"]).alias("education"),
        F.col("pay.min").alias("salary_min"),
        F.col("pay.max").alias("salary_max"),
        w["sal"].alias("salary_raw"),
        w["regionCd"].alias("region_code"),
        w["workRegion"].alias("region_name"),
        parse.lenient_date(p["regDt"]).alias("posted_at"),
        F.col("until.date").alias("deadline"),
        w["dtlRecrContUrl"].alias("url"),
        F.when(any_flag, flags).alias("parse_flags"),
        *ORDER,
    )


def contract_filter(jobs: DataFrame, key: str = "source_id", title: str = "title", longest: int = 300) -> DataFrame:
    return jobs.where(F.col(key).isNotNull() & F.col(title).isNotNull() & F.length(title).between(1, longest))


def contract_nulling(jobs: DataFrame, most_years: int = 40, least_pay: int = 1_000_000) -> DataFrame:
    """Values out of range become null: first exp_min and salary_min, then the maxima against what is left of the minima."""
    first = jobs.withColumns({"exp_min": F.when(F.col("exp_min").between(0, most_years), F.col("exp_min")), "salary_min": F.when(F.col("salary_min") >= least_pay, F.col("salary_min"))})
    above = lambda c, low: F.col(c) >= F.coalesce(F.col(low), F.lit(0))
    return first.withColumns({"exp_max": F.when(F.col("exp_max").between(0, most_years) & above("exp_max", "exp_min"), F.col("exp_max")), "salary_max": F.when(above("salary_max", "salary_min"), F.col("salary_max"))})


def apply_contract(jobs: DataFrame) -> DataFrame:
    """Contract, then the last version of each posting."""
    return keep_last(contract_nulling(contract_filter(jobs)), ["source", "source_id"], ORDER)


def extract_companies(jobs: DataFrame) -> DataFrame:
    """A row for each non-empty company key, with the attributes of its first posting."""
    named = jobs.select(*COMPANY_COLUMNS, *ORDER).where(F.length("company_name_normalized") > 0)
    return keep_first(named, ["company_name_normalized"], ORDER).select(*COMPANY_COLUMNS)


@dataclass(frozen=True)
class Normalized:
    jobs: DataFrame
    companies: DataFrame
    #: rows_in, violations, duplicates and dropped (both), in one row.
    dropped: DataFrame


def normalize(raw: DataFrame) -> Normalized:
    flat = flatten(raw)
    jobs = apply_contract(flat)
    kept = F.broadcast(jobs.agg(F.count("*").alias("rows_out")))
    valid = F.broadcast(contract_filter(flat).agg(F.count("*").alias("valid")))
    counts = flat.agg(F.count("*").alias("rows_in")).crossJoin(valid).crossJoin(kept)
    dropped = counts.select("rows_in", (F.col("rows_in") - F.col("valid")).alias("violations"), (F.col("valid") - F.col("rows_out")).alias("duplicates"), (F.col("rows_in") - F.col("rows_out")).alias("dropped"))
    return Normalized(jobs, extract_companies(jobs), dropped)


def attach_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with company_id; no match leaves null. The optimizer broadcasts companies only where their size allows."""
    ids = companies.select(F.col("name_normalized").alias("__name"), F.col("id").alias("company_id"))
    return jobs.join(ids, jobs["company_name_normalized"] == ids["__name"], "left").drop("__name")


def list_row(raw: DataFrame) -> DataFrame:
    """Detail payloads as the 18 flat columns of a list page."""
    w, c, p = F.col("p.wantedInfo"), F.col("p.corpInfo"), F.col("p")
    picks = {
        "wantedAuthNo": p["wantedAuthNo"], "company": c["corpNm"], "indTpNm": c["indTpCdNm"], "title": w["wantedTitle"], "salTpNm": w["salTpNm"], "sal": w["sal"], "minSal": w["minSal"], "maxSal": w["maxSal"], "region": w["workRegion"],
        "minEdubg": w["eduNm"], "career": w["enterTpNm"], "regDt": p["regDt"], "closeDt": w["receiptCloseDt"], "infoSvc": p["infoSvc"], "wantedInfoUrl": w["dtlRecrContUrl"], "empTpCd": w["empTpCd"], "jobsCd": w["jobsCd"], "smodifyDtm": p["smodifyDtm"],
    }
    return raw.withColumn("p", F.from_json("payload", DETAIL)).select(*[v.alias(k) for k, v in picks.items()])
