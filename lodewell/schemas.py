"""Fixed schemas: payloads are read through them and frames are built to them, so empty or all-null input keeps its types."""

from __future__ import annotations

CORP = "STRUCT<corpNm STRING, reperNm STRING, totPsncnt INT, capitalAmt BIGINT, yrSalesAmt BIGINT, indTpCdNm STRING, busiCont STRING, corpAddr STRING, homePg STRING, busiSize STRING>"
WANTED = (
    "STRUCT<wantedTitle STRING, jobCont STRING, certificate STRING, pfCond STRING, etcPfCond STRING, sal STRING, salTpCd STRING, salTpNm STRING, minSal STRING, maxSal STRING, "
    "enterTpNm STRING, enterTpCd STRING, receiptCloseDt STRING, minEdubgIcd STRING, eduNm STRING, empTpCd STRING, empTpNm STRING, jobsNm STRING, relJobsNm STRING, jobsCd STRING, "
    "regionCd STRING, workRegion STRING, collectPsncnt STRING, dtlRecrContUrl STRING, keywordList STRUCT<srchKeywordNm ARRAY<STRING>>>"
)
#: A posting's payload; contact fields are not in it, so reading through it drops them.
DETAIL = f"wantedAuthNo STRING, regDt STRING, smodifyDtm STRING, infoSvc STRING, corpInfo {CORP}, wantedInfo {WANTED}"
RAW = "id BIGINT, source STRING, source_id STRING, endpoint STRING, payload STRING, content_hash STRING, fetched_at TIMESTAMP, processed_at TIMESTAMP"
SECTIONS = "STRUCT<main_tasks STRING, requirements STRING, preferred STRING>"
FLAGS = "STRUCT<salary STRING, experience STRING, deadline STRING>"
JOB = (
    f"source STRING, source_id STRING, company_name STRING, company_name_normalized STRING, industry_name STRING, size_category STRING, homepage STRING, title STRING, description STRING, sections {SECTIONS}, "
    f"job_category STRING, employment_type STRING, exp_min SMALLINT, exp_max SMALLINT, education STRING, salary_min BIGINT, salary_max BIGINT, salary_raw STRING, "
    f"region_code STRING, region_name STRING, posted_at DATE, deadline DATE, url STRING, parse_flags {FLAGS}"
)
COMPANY = "id BIGINT, name STRING, name_normalized STRING, biz_no STRING, industry_code STRING, industry_name STRING, size_category STRING, homepage STRING"
SKILL = "id INT, canonical_name STRING, category STRING, aliases ARRAY<STRING>, match_patterns ARRAY<STRING>, is_active BOOLEAN"
JOB_TABLE = f"id BIGINT, company_id BIGINT, {JOB.replace(', parse_flags', ', status STRING, parse_flags')}, content_hash STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
JOB_SKILL = "job_id BIGINT, skill_id INT, is_required BOOLEAN, occurrences INT, confidence FLOAT, extracted_by STRING"
RUN = "id BIGINT, source STRING, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP, api_calls INT, fetched_count INT, new_count INT, error_count INT, error_detail STRING"

#: Keys that carry personal data; they go before anything is hashed or stored.
PII_KEYS = ("empchargeInfo", "empChargerDpt", "empChargerHp", "chargerEmail", "chargerFaxNo", "contactTelno")
CATEGORIES = ("language", "framework", "database", "cloud", "tool", "soft", "domain")
STATUSES = ("open", "closed", "expired")
#: What a run ends as.
RUN_STATUSES = ("running", "success", "budget", "failed")
#: The tables by name; keys are unique, and nothing but the schema is declared: there are no indexes.
TABLES = {"raw_job_postings": RAW, "ingestion_runs": RUN, "companies": COMPANY, "jobs": JOB_TABLE, "skills": SKILL, "job_skills": JOB_SKILL}
#: What a column has in a new row that does not bring it.
DEFAULTS = {
    "raw_job_postings": {"fetched_at": "now"},
    "ingestion_runs": {"status": "running", "started_at": "now", "api_calls": 0, "fetched_count": 0, "new_count": 0, "error_count": 0},
    "jobs": {"status": "open", "created_at": "now", "updated_at": "now"},
    "skills": {"aliases": [], "is_active": True},
    "job_skills": {"is_required": False, "occurrences": 1, "confidence": 1.0},
}
