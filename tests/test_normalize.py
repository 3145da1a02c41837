"""Payloads to postings: flattening, contract, deduplication, companies, metrics."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from lodewell.functions.hashing import content_hash, row_hash, scrub_pii
from lodewell.operators import normalize, quality
from lodewell.operators.raw import documents


def payload(i="SAMPLE-000001", company="(주)테스트", **wanted):
    base = {"wantedTitle": "백엔드 개발자", "jobCont": "Python 기반 API 개발", "pfCond": "AWS 우대", "sal": "연 4000~5000만원", "salTpCd": "Y", "enterTpNm": "경력 3년 이상", "enterTpCd": "E", "receiptCloseDt": "2026-10-01", "minEdubgIcd": "05", "empTpCd": "10", "regionCd": "11000"}
    return {"wantedAuthNo": i, "regDt": "2026-09-01", "corpInfo": {"corpNm": company}, "wantedInfo": base | wanted, "empchargeInfo": {"contactTelno": "02"}}


def raw(spark, payloads):
    rows = [(n, "sample", json.dumps(p, ensure_ascii=False), datetime(2026, 9, 15)) for n, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id long, source string, payload string, fetched_at timestamp")


def test_flatten(spark):
    r = normalize.flatten(raw(spark, [payload()])).first()
    assert (r.company_name_normalized, r.exp_min, r.salary_min, r.education, r.employment_type, r.parse_flags) == ("테스트", 3, 40_000_000, "bachelor", "fulltime", None)
    assert r.description == "Python 기반 API 개발\n\nAWS 우대" and r.sections.requirements == ""


def test_flatten_of_missing_objects(spark):
    r = normalize.flatten(raw(spark, [{"wantedAuthNo": "x"}, {}])).orderBy("id").collect()
    assert r[0].source_id == "x" and r[0].title is None and r[0].description is None and r[0].company_name_normalized == ""
    assert r[0].parse_flags.salary == "empty" and r[1].source_id is None


def test_empty_input_keeps_types(spark):
    jobs = normalize.normalize(raw(spark, [payload()]).limit(0)).jobs
    types = dict(jobs.dtypes)
    assert jobs.count() == 0 and types["exp_min"] == "smallint" and types["salary_min"] == "bigint" and types["posted_at"] == "date"
    assert quality.fill_rate(jobs).count() == 0


def test_contract(spark):
    n = normalize.normalize(raw(spark, [payload("a"), payload("b", wantedTitle=None), payload("c", wantedTitle="x" * 301), payload("a", wantedTitle="나중")]))
    kept = n.jobs.collect()
    assert [(r.source_id, r.title) for r in kept] == [("a", "나중")]
    assert n.dropped.first().asDict() == {"rows_in": 4, "violations": 2, "duplicates": 1, "dropped": 3}


def test_contract_nulling(spark):
    df = spark.createDataFrame([(99, 5, 1000, 500), (3, 2, 2_000_000, 1_500_000), (None, 7, None, 9)], "exp_min smallint, exp_max smallint, salary_min long, salary_max long")
    got = [tuple(r) for r in normalize.contract_nulling(df).collect()]
    assert got == [(None, 5, None, 500), (3, None, 2_000_000, None), (None, 7, None, 9)]


def test_companies(spark):
    jobs = normalize.normalize(raw(spark, [payload("a", "(주)카카오"), payload("b", "카카오(주)"), payload("c", "㈜네이버"), payload("d", "")])).companies
    assert {(r.company_name_normalized, r.company_name) for r in jobs.collect()} == {("카카오", "(주)카카오"), ("네이버", "㈜네이버")}


def test_fill_rate(spark):
    jobs = normalize.normalize(raw(spark, [payload("a"), payload("b", sal="협의")])).jobs
    rates = {r.column_name: r.fill_rate for r in quality.fill_rate(jobs).collect()}
    assert rates["source_id"] == 1.0 and rates["salary_min"] == 0.5
    assert quality.least_filled(jobs, 5).count() == 5


def test_list_row(spark):
    r = normalize.list_row(raw(spark, [payload()])).first()
    assert len(r) == 18 and r.company == "(주)테스트" and r.sal == "연 4000~5000만원"


def test_hashes_ignore_key_order_and_personal_data(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"d":1,"c":2}}',), ('{ "b":{"c":2,"d":1}, "a":1}',), ('{"a":2}',)], "payload string")
    h = [r.h for r in df.select(content_hash(F.col("payload")).alias("h")).collect()]
    assert h[0] == h[1] != h[2] and len(h[0]) == 64
    p = payload()
    rows = spark.createDataFrame([("s", "1", "detail", json.dumps(p)), ("s", "1", "detail", json.dumps({k: v for k, v in p.items() if k != "empchargeInfo"}))], "source string, source_id string, endpoint string, payload string")
    assert documents(rows).select("content_hash").distinct().count() == 1


def test_scrub_nested(spark):
    text = json.dumps({"a": [{"contactTelno": "1", "b": 2}], "c": {"chargerEmail": "x", "d": {"empChargerHp": 1, "e": 3}}})
    df = spark.createDataFrame([(text,), ("no json",), (None,)], "p string")
    got = [r.x for r in df.select(scrub_pii(F.col("p")).alias("x")).collect()]
    assert json.loads(got[0]) == {"a": [{"b": 2}], "c": {"d": {"e": 3}}} and got[1:] == ["no json", None]


def test_row_hash_counts_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "y string, x string")
    assert df.select(row_hash(["y", "x"]).alias("h")).distinct().count() == 2


def test_filters_make_and_parse_payloads_once(spark):
    """The contract's filter stays above the parse, so a payload is scrubbed and parsed once."""
    import re

    from lodewell.operators import raw

    rows = spark.range(3).selectExpr("id", "'s' AS source", "concat('{\"wantedAuthNo\":\"', id, '\",\"wantedInfo\":{\"wantedTitle\":\"x\"}}') AS payload", "timestamp'2026-09-15' AS fetched_at")
    jobs = normalize.normalize(raw.documents(rows)).jobs
    plan = jobs.select("source_id", "title", "exp_min")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", plan)) == 1 and len(re.findall(r"\bscrub\(", plan)) == 1
