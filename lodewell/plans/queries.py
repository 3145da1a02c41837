"""Registered queries over the test tables, and a DuckDB query for each that SQL can express.

Posting fields are derived from columns of the tables by the same expression in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions import hashing, parse, search
from lodewell.operators import dedup, merge, normalize, quality, rank, raw, skills
from lodewell.session import shared_dir
from lodewell.sources import dictionary, synthetic
from lodewell.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(key: str, texts: list[str], engine: str) -> str:
    """A CASE over key modulo the number of texts, which SQL of both engines reads alike. {k} in a text is the key's own digit string."""
    parts = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(texts))
    return f"CASE {key} % {len(texts)} {parts} END"


# Parsers

CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT page_id, {CLEAN_SQL.format('html')} AS cleaned FROM pages")
def clean_text_pages(spark, d):
    return t(spark, d, "pages").select("page_id", parse.clean_text(F.col("html")).alias("cleaned"))


COMPANY_TEXT = "CASE c_custkey % 6 WHEN 0 THEN concat('(주)회사', c_custkey % 300) WHEN 1 THEN concat('회사', c_custkey % 300, '(주)') WHEN 2 THEN concat('회사', c_custkey % 300, ' 주식회사') WHEN 3 THEN concat('㈜회사', c_custkey % 300) WHEN 4 THEN concat(' 회사', c_custkey % 300, ' ') ELSE '(주)' END"
COMPANY_KEY_SQL = r"regexp_replace(regexp_replace({0}, '\(주\)|㈜|주식회사|\(유\)|유한회사|\(재\)|재단법인', '', 'g'), '\s+', '', 'g')"


@query(f"SELECT c_custkey, {COMPANY_KEY_SQL.format(COMPANY_TEXT)} AS name_key FROM customer")
def normalize_company_name(spark, d):
    return t(spark, d, "customer").select("c_custkey", parse.company_key(F.expr(COMPANY_TEXT)).alias("name_key"))


@query(f"""
WITH c AS (SELECT c_custkey, {COMPANY_TEXT} AS company_name, {COMPANY_KEY_SQL.format(COMPANY_TEXT)} AS name_key, c_mktsegment FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY c_custkey) AS r FROM c WHERE length(name_key) > 0)
SELECT name_key, company_name, c_mktsegment FROM r WHERE r = 1""")
def extract_companies(spark, d):
    named = t(spark, d, "customer").select("c_custkey", F.expr(COMPANY_TEXT).alias("company_name"), parse.company_key(F.expr(COMPANY_TEXT)).alias("name_key"), "c_mktsegment")
    return dedup.keep_first(named.where(F.length("name_key") > 0), ["name_key"], ["c_custkey"]).select("name_key", "company_name", "c_mktsegment")


N = "(2600 + o_orderkey % 5000)"
SALARY_TEXT = f"CASE o_orderkey % 9 WHEN 0 THEN concat('연 ', {N}, '~', {N} + 1500, '만원') WHEN 1 THEN '회사내규에 따름' WHEN 2 THEN concat('월 ', 200 + o_orderkey % 300, '만원') WHEN 3 THEN concat('연 ', {N}, '만원 이상') WHEN 4 THEN '시급 12,000원' WHEN 5 THEN '' WHEN 6 THEN concat({N}, '만원 ~ ', {N} + 700, '만원 (', {N} + 300, ')') WHEN 7 THEN '일급 90000원' ELSE '면접 후 결정하며 아주 긴 설명이 붙는 급여 조건입니다' END"
SALARY_CODE = "CASE WHEN o_orderkey % 7 = 0 THEN 'm' WHEN o_orderkey % 11 = 0 THEN 'H' WHEN o_orderkey % 13 = 0 THEN 'D' ELSE 'Y' END"
SALARY_SQL = f"""
WITH a AS (SELECT o_orderkey, {SALARY_TEXT} AS x, upper({SALARY_CODE}) AS c FROM orders),
n AS (SELECT *, list_transform(regexp_extract_all(x, '[0-9][0-9,]*'), lambda v: CAST(replace(v, ',', '') AS BIGINT) * CASE WHEN contains(x, '월') OR c = 'M' THEN 120000 ELSE 10000 END) AS v FROM a),
p AS (SELECT o_orderkey, v, CASE WHEN x = '' THEN 'empty' WHEN len(v) = 0 THEN 'no_number:' || left(x, 20) WHEN contains(x, '시급') OR c = 'H' THEN 'hourly:' || left(x, 20) WHEN contains(x, '일급') OR c = 'D' THEN 'daily:' || left(x, 20) END AS note FROM n)
"""


def salaries(spark, d) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", parse.salary(F.expr(SALARY_TEXT), F.expr(SALARY_CODE)).alias("p"))


@query(f"{SALARY_SQL} SELECT o_orderkey, CASE WHEN note IS NULL THEN list_min(v) END AS salary_min, CASE WHEN note IS NULL AND len(v) > 1 THEN list_max(v) END AS salary_max, note FROM p")
def parse_salary(spark, d):
    return salaries(spark, d).select("o_orderkey", F.col("p.min").alias("salary_min"), F.col("p.max").alias("salary_max"), F.col("p.note").alias("note"))


EXP_TEXT = "CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN '경력무관' WHEN 1 THEN '신입 채용' WHEN 2 THEN concat(l_linenumber, '~', l_linenumber + 4, '년') WHEN 3 THEN concat('경력 ', 12 * l_linenumber + 6, '개월 이상') WHEN 4 THEN concat(l_linenumber, '년차 이상') WHEN 5 THEN '담당자 문의 바랍니다 자세한 내용은 전화로 주세요' WHEN 6 THEN '1년 6개월' WHEN 7 THEN '3년~7년' ELSE '' END"
EXP_CODE = "CASE l_orderkey % 10 WHEN 0 THEN 'z' WHEN 1 THEN 'N' ELSE 'E' END"


@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {EXP_TEXT} AS x, upper({EXP_CODE}) AS c FROM lineitem),
g AS (SELECT *, c = 'Z' OR contains(x, '무관') OR contains(x, '신입/경력') AS anyone, c = 'N' OR contains(x, '신입') AS beginner,
    nullif(regexp_extract(x, '([0-9]+)\\s*[~–-]\\s*([0-9]+)\\s*년', 1), '') AS lo, nullif(regexp_extract(x, '([0-9]+)\\s*[~–-]\\s*([0-9]+)\\s*년', 2), '') AS hi,
    nullif(regexp_extract(x, '([0-9]+)\\s*개월', 1), '') AS mo, nullif(regexp_extract(x, '([0-9]+)\\s*년', 1), '') AS yr FROM a)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN anyone OR beginner THEN 0 WHEN lo IS NOT NULL THEN CAST(lo AS BIGINT) WHEN mo IS NOT NULL THEN CAST(mo AS BIGINT) // 12 WHEN yr IS NOT NULL THEN CAST(yr AS BIGINT) END AS SMALLINT) AS exp_min,
    CAST(CASE WHEN anyone THEN NULL WHEN beginner THEN 0 WHEN lo IS NOT NULL THEN CAST(hi AS BIGINT) END AS SMALLINT) AS exp_max,
    CASE WHEN NOT (anyone OR beginner) AND coalesce(lo, mo, yr) IS NULL THEN 'unparsed:' || left(x, 20) END AS note FROM g""")
def parse_experience(spark, d):
    p = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.experience(F.expr(EXP_TEXT), F.expr(EXP_CODE)).alias("p"))
    return p.select("l_orderkey", "l_linenumber", F.col("p.min").alias("exp_min"), F.col("p.max").alias("exp_max"), F.col("p.note").alias("note"))


DAY = "substr(CAST(o_orderdate AS {0}), {1}, {2})"


def deadline_text(string: str) -> str:
    y, m, dd = (DAY.format(string, a, n) for a, n in ((1, 4), (6, 2), (9, 2)))
    return f"CASE o_orderkey % 8 WHEN 0 THEN concat({y}, '-', {m}, '-', {dd}) WHEN 1 THEN concat({y}, '.', {m}, '.', {dd}) WHEN 2 THEN concat('마감 ', {y}, '/', {m}, '/', {dd}) WHEN 3 THEN '상시채용' WHEN 4 THEN '2026-13-45' WHEN 5 THEN '' WHEN 6 THEN concat({y}, '-', {m}, '-', {dd}, ' 채용시 마감') ELSE '별도 안내 예정이오니 홈페이지를 참고하세요' END"


@query(f"""
WITH a AS (SELECT o_orderkey, {deadline_text('VARCHAR')} AS x FROM orders),
g AS (SELECT *, regexp_extract(x, '([0-9]{{4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,2}})', 1) AS y, regexp_extract(x, '([0-9]{{4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,2}})', 2) AS m, regexp_extract(x, '([0-9]{{4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,2}})', 3) AS dd FROM a),
p AS (SELECT o_orderkey, CAST(try_strptime(y || '-' || m || '-' || dd, '%Y-%m-%d') AS DATE) AS day, x, y FROM g),
n AS (SELECT o_orderkey, day, CASE WHEN x = '' THEN 'empty' WHEN regexp_matches(x, '상시|채용시|수시') THEN 'open_ended' WHEN y = '' THEN 'unparsed:' || left(x, 20) WHEN day IS NULL THEN 'invalid_date:' || left(x, 20) END AS note FROM p)
SELECT o_orderkey, CASE WHEN note IS NULL THEN day END AS deadline, note FROM n""")
def parse_deadline(spark, d):
    p = t(spark, d, "orders").select("o_orderkey", parse.deadline(F.expr(deadline_text("STRING"))).alias("p"))
    return p.select("o_orderkey", F.col("p.date").alias("deadline"), F.col("p.note").alias("note"))


EDU, EMP = "concat('0', CAST(p_size % 10 AS {0}), ' ')", "CASE p_size % 6 WHEN 0 THEN '10' WHEN 1 THEN '11' WHEN 2 THEN '20' WHEN 3 THEN '21' WHEN 4 THEN '4' ELSE 'ZZ' END"


@query(f"""SELECT p_partkey, CASE trim({EDU.format('VARCHAR')}) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in parse.EDUCATION.items())} END AS education,
    CASE {EMP} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in parse.EMPLOYMENT.items())} END AS employment FROM part""")
def code_map_lookup(spark, d):
    return t(spark, d, "part").select("p_partkey", parse.education(F.expr(EDU.format("STRING"))).alias("education"), parse.employment(F.expr(EMP)).alias("employment"))


POSTED = "CASE o_orderkey % 4 WHEN 0 THEN 'soon' WHEN 1 THEN '2026-02-30' ELSE substr(CAST(o_orderdate AS {0}), 1, 10) END"


@query(f"SELECT o_orderkey, CAST(try_strptime({POSTED.format('VARCHAR')}, '%Y-%m-%d') AS DATE) AS posted_at FROM orders")
def posted_at_lenient_date(spark, d):
    return t(spark, d, "orders").select("o_orderkey", parse.lenient_date(F.expr(POSTED.format("STRING"))).alias("posted_at"))


# Hashes and personal data


@query("SELECT event_id, sha256('{\"k\":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '}') AS content_hash FROM events")
def raw_content_hash(spark, d):
    return t(spark, d, "events").select("event_id", hashing.content_hash(F.col("props")).alias("content_hash"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS content_hash FROM orders""")
def job_content_hash(spark, d):
    return t(spark, d, "orders").select("o_orderkey", hashing.row_hash(["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("content_hash"))


@query("""SELECT event_id, '{"id":' || event_id || ',"list":[{"x":1}],"corp":{"name":"' || event_type || '"}}' AS payload FROM events""")
def pii_scrub(spark, d):
    text = F.format_string('{"id":%d,"list":[{"x":1,"chargerEmail":"a@b"}],"corp":{"name":"%s","contactTelno":"1"},"empchargeInfo":{"a":1}}', F.col("event_id"), F.col("event_type"))
    return t(spark, d, "events").select("event_id", hashing.scrub_pii(text).alias("payload"))


# Raw layer

HASHED = "SELECT doc_id, source, sha256(text) AS content_hash FROM documents"


def hashed(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))


@query(f"""
WITH h AS ({HASHED}), old AS (SELECT * FROM h WHERE doc_id % 10 < 3), new AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS r FROM h WHERE doc_id % 10 >= 3)
SELECT doc_id, source, content_hash FROM new WHERE r = 1 AND content_hash NOT IN (SELECT content_hash FROM old)""")
def raw_insert_ignore(spark, d):
    h = hashed(spark, d)
    return dedup.insert_ignore(h.where("doc_id % 10 < 3"), h.where("doc_id % 10 >= 3"), ["content_hash"], ["doc_id"])


@query(f"""
WITH h AS ({HASHED}), old AS (SELECT * FROM h WHERE doc_id % 10 < 3), new AS (SELECT * FROM h WHERE doc_id % 10 >= 3),
i AS (SELECT count(DISTINCT content_hash) AS inserted FROM new WHERE content_hash NOT IN (SELECT content_hash FROM old))
SELECT (SELECT count(*) FROM new) AS fetched, inserted, (SELECT count(*) FROM new) - inserted AS duplicates FROM i""")
def raw_insert_counts(spark, d):
    h = hashed(spark, d)
    return dedup.insert_counts(h.where("doc_id % 10 < 3"), h.where("doc_id % 10 >= 3"), ["content_hash"], ["doc_id"])


def raw_events(spark, d) -> DataFrame:
    """events as a raw table: half of the types are details, errors are processed."""
    e = t(spark, d, "events")
    processed = F.when(F.col("event_type") == "error", F.col("ts"))
    return e.select(F.col("event_id").alias("id"), F.lit("sample").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.lit("detail").alias("endpoint"), F.col("props").alias("payload"), F.col("ts").alias("fetched_at"), processed.alias("processed_at"))


@query("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source_id, props AS payload, ts AS fetched_at FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 5000")
def pending_scan(spark, d):
    return raw.pending(raw_events(spark, d), "sample")


@query("""WITH p AS (SELECT user_id FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 500)
SELECT event_id AS id, CASE WHEN user_id IN (SELECT user_id FROM p) THEN TIMESTAMP '2026-09-15 00:00:00' WHEN event_type = 'error' THEN ts END AS processed_at FROM events""")
def mark_processed(spark, d):
    e = raw_events(spark, d)
    return raw.mark_processed(e, "sample", raw.pending(e, "sample", 500), F.lit("2026-09-15 00:00:00").cast("timestamp")).select("id", "processed_at")


@query("SELECT event_id AS id, CAST(NULL AS TIMESTAMP) AS processed_at FROM events")
def reset_processed(spark, d):
    return raw.reset(raw_events(spark, d), "sample").select("id", "processed_at")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def delete_where(spark, d):
    return merge.delete_where(t(spark, d, "events").select("event_id", "event_type"), F.col("event_type") == "error")


@query("SELECT CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS pending, CAST(count(*) AS BIGINT) AS total FROM events")
def pending_and_total_counts(spark, d):
    return raw_events(spark, d).agg(F.count_if(F.col("processed_at").isNull()).alias("pending"), F.count("*").alias("total"))


@query("SELECT lang AS endpoint, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def count_by_endpoint(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("endpoint")).agg(F.count("*").alias("n")).orderBy("endpoint")


# Contract

TITLE = "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE text END"


@query(f"SELECT doc_id FROM documents WHERE length({TITLE}) BETWEEN 1 AND 300")
def contract_filter(spark, d):
    titled = t(spark, d, "documents").select("doc_id", F.expr(TITLE).alias("title"))
    return normalize.contract_filter(titled, "doc_id").select("doc_id")


LIMITS = "o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 60 - 5 END AS SMALLINT) AS exp_min, CAST(o_orderkey % 50 AS SMALLINT) AS exp_max, CAST(o_orderkey % 4 * 700000 AS BIGINT) AS salary_min, CAST(o_orderkey % 6 * 500000 AS BIGINT) AS salary_max"


@query(f"""
WITH a AS (SELECT {LIMITS} FROM orders),
b AS (SELECT o_orderkey, CASE WHEN exp_min BETWEEN 0 AND 40 THEN exp_min END AS exp_min, exp_max, CASE WHEN salary_min >= 1000000 THEN salary_min END AS salary_min, salary_max FROM a)
SELECT o_orderkey, exp_min, CASE WHEN exp_max BETWEEN 0 AND 40 AND exp_max >= coalesce(exp_min, 0) THEN exp_max END AS exp_max, salary_min, CASE WHEN salary_max >= coalesce(salary_min, 0) THEN salary_max END AS salary_max FROM b""")
def contract_nulling(spark, d):
    return normalize.contract_nulling(t(spark, d, "orders").selectExpr(*LIMITS.replace(", CAST", "\nCAST").split("\n")))


def windowed(direction: str) -> str:
    return f"SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {direction}, event_id {direction}) AS r FROM events) WHERE r = 1"


@query(windowed("DESC"))
def dedup_keep_last(spark, d):
    return dedup.keep_last(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(windowed("ASC"))
def dedup_keep_first(spark, d):
    return dedup.keep_first(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(f"""
WITH a AS (SELECT doc_id, {TITLE} AS title, sha256(text) AS h FROM documents), v AS (SELECT * FROM a WHERE length(title) BETWEEN 1 AND 300)
SELECT (SELECT count(*) FROM a) AS rows_in, (SELECT count(*) FROM a) - (SELECT count(*) FROM v) AS violations, (SELECT count(*) FROM v) - (SELECT count(DISTINCT h) FROM v) AS duplicates""")
def dropped_counts(spark, d):
    titled = t(spark, d, "documents").select("doc_id", F.expr(TITLE).alias("title"), F.sha2("text", 256).alias("h"))
    valid = normalize.contract_filter(titled, "doc_id")
    kept = dedup.keep_last(valid, ["h"], ["doc_id"]).agg(F.count("*").alias("kept"))
    counts = titled.agg(F.count("*").alias("rows_in")).crossJoin(F.broadcast(valid.agg(F.count("*").alias("valid")))).crossJoin(F.broadcast(kept))
    return counts.select("rows_in", (F.col("rows_in") - F.col("valid")).alias("violations"), (F.col("valid") - F.col("kept")).alias("duplicates"))


# Quality

LABELLED = ["doc_id", "lang", "source", "quality", "toxic"]
RATES = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name, round(1 - CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*), 4) AS fill_rate FROM j" for i, c in enumerate(LABELLED))


def labelled(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id", "left").select(*LABELLED)


@query(f"WITH j AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT column_name, fill_rate FROM ({RATES})")
def fill_rate_long(spark, d):
    return quality.fill_rate(labelled(spark, d)).select("column_name", "fill_rate")


@query(f"WITH j AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT column_name, fill_rate FROM ({RATES}) ORDER BY fill_rate, position LIMIT 5")
def fill_rate_bottom5(spark, d):
    return quality.least_filled(labelled(spark, d))


@query(f"{SALARY_SQL} SELECT 'salary' AS field, count(*) AS total, count(*) FILTER (note IS NULL) AS parsed, round(CAST(count(*) FILTER (note IS NULL) AS DOUBLE) / count(*), 4) AS success_rate FROM p")
def parse_success_rate(spark, d):
    return quality.parse_success(salaries(spark, d), {"salary": F.col("p.note")})


@query("""SELECT 'toxic_is_flag' AS check_name, CAST(count(*) FILTER (NOT (toxic IN (0, 1))) AS BIGINT) AS violations FROM labels
UNION ALL SELECT 'not_both', CAST(count(*) FILTER (NOT (toxic + quality <= 1)) AS BIGINT) FROM labels""")
def check_violations(spark, d):
    return quality.check_violations(t(spark, d, "labels"), {"toxic_is_flag": F.col("toxic").isin(0, 1), "not_both": F.col("toxic") + F.col("quality") <= 1})


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, d):
    return quality.unique_violations(t(spark, d, "events"), ["user_id", "event_type"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def foreign_key_set_null(spark, d):
    parents = t(spark, d, "customer").where("c_custkey % 7 <> 0")
    return quality.orphans_to_null(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def foreign_key_cascade(spark, d):
    parents = t(spark, d, "customer").where("c_custkey % 7 <> 0")
    return quality.cascade(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type")
def category_histogram(spark, d):
    return quality.histogram(t(spark, d, "part"), "p_type")


# Merges

VERSIONS = "doc_id, lang, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h"
MERGE_SQL = f"""WITH o AS (SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE doc_id % 10 < 8), s AS (SELECT {VERSIONS} FROM documents WHERE doc_id % 10 > 1),
m AS (SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN NULL WHEN o.doc_id IS NULL THEN 'insert' WHEN o.h IS DISTINCT FROM s.h THEN 'update' ELSE 'skip' END AS action, CASE WHEN s.doc_id IS NULL OR o.h = s.h THEN o.h ELSE s.h END AS h FROM o FULL JOIN s ON o.doc_id = s.doc_id)"""


def merged(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    target = docs.where("doc_id % 10 < 8").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    source = docs.where("doc_id % 10 > 1").select("doc_id", "lang", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return merge.merge(target, source, ["doc_id"], hash_column="h")


@query(f"{MERGE_SQL} SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped FROM m")
def merge_actions(spark, d):
    return merge.tally(merged(spark, d))


@query(f"{MERGE_SQL} SELECT doc_id, h, action FROM m")
def merge_result(spark, d):
    return merged(spark, d).select("doc_id", "h", "action")


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey AS VARCHAR) AS size FROM supplier WHERE s_suppkey % 3 <> 0), s AS (SELECT s_suppkey AS k, upper(s_name) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'x' END AS size FROM supplier WHERE s_suppkey % 3 <> 1)
SELECT coalesce(s.k, o.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.name ELSE o.name END AS name, CASE WHEN s.k IS NOT NULL THEN s.size ELSE o.size END AS size FROM o FULL JOIN s ON o.k = s.k""")
def upsert_dimension(spark, d):
    s = t(spark, d, "supplier")
    target = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("size"))
    source = s.where("s_suppkey % 3 <> 1").select(F.col("s_suppkey").alias("k"), F.upper("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "x").alias("size"))
    return merge.merge(target, source, ["k"]).drop("action")


@query("SELECT s_name, CAST(row_number() OVER (ORDER BY s_name) AS BIGINT) AS id FROM supplier")
def surrogate_ids(spark, d):
    rows = t(spark, d, "supplier").select("s_name", F.lit(None).cast("bigint").alias("id"))
    return merge.with_surrogate_ids(rows, "id", ["s_name"])


# Joins, set operations, paging


@query("SELECT o_orderkey, c_custkey AS company_id FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def attach_company_id(spark, d):
    jobs = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("company_name_normalized"))
    companies = t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("name_normalized"))
    return normalize.attach_company(jobs, companies).select("o_orderkey", "company_id")


@query("SELECT c_name, CAST(count(*) AS BIGINT) AS postings FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def inner_join_companies(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_name").agg(F.count("*").alias("postings"))


@query("SELECT o_orderkey AS source_id, 'list' AS endpoint FROM orders UNION ALL SELECT DISTINCT o_orderkey, 'detail' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def list_detail_union(spark, d):
    pages = t(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"))
    details = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id"))
    return raw.list_and_details(pages, details.distinct())


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page_slice(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(200).limit(100)


@query("""WITH a AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p, list_distinct(list(o_orderstatus)) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_filter(p, lambda x: x IN ('1-URGENT', '2-HIGH'))), ',') AS required, array_to_string(list_sort(list_filter(p, lambda x: x NOT IN ('1-URGENT', '2-HIGH'))), ',') AS preferred, CAST(len(list_distinct(list_concat(p, s))) AS INTEGER) AS emitted FROM a""")
def array_set_ops(spark, d):
    a = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    core = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return a.select("o_custkey", F.array_join(F.array_sort(F.filter("p", lambda x: F.array_contains(core, x))), ",").alias("required"), F.array_join(F.array_sort(F.array_except("p", core)), ",").alias("preferred"), F.size(F.array_union("p", "s")).alias("emitted"))


# Skills and search

WORDS = [("the", "language", ["of", "and"], []), ("der", "tool", ["die", "das"], []), ("idiot", "soft", ["moron"], [])]
FORMS = "SELECT * FROM (VALUES ('the', 'the'), ('of', 'the'), ('and', 'the'), ('der', 'der'), ('die', 'der'), ('das', 'der'), ('idiot', 'idiot'), ('moron', 'idiot')) f(form, skill)"


@query(f"""WITH f AS ({FORMS}), w AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_+#][\\p{{L}}\\p{{M}}\\p{{N}}_+#.-]*')), '[.-]+$', '') AS form FROM documents)
SELECT doc_id, skill, CAST(count(*) AS BIGINT) AS occurrences FROM w JOIN f USING (form) GROUP BY ALL""")
def alias_lookup(spark, d):
    return skills.match_words(t(spark, d, "documents"), "doc_id", "text", dictionary.skills(spark, WORDS))


@query(r"""SELECT * FROM (SELECT doc_id, 'ing' AS skill, CAST(len(regexp_extract_all(text, '\b[Ii]ng\b')) AS BIGINT) AS occurrences FROM documents UNION ALL SELECT doc_id, 'A', CAST(len(regexp_extract_all(text, '\bA\b')) AS BIGINT) FROM documents) WHERE occurrences > 0""")
def skill_extraction(spark, d):
    patterns = {"ing": r"(?<![0-9A-Za-z_])[Ii]ng(?![0-9A-Za-z_])", "A": r"(?<![0-9A-Za-z_])A(?![0-9A-Za-z_])"}
    return skills.match_patterns(t(spark, d, "documents"), "doc_id", "text", patterns)


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])idiot([^\\p{L}\\p{M}\\p{N}_]|$)')")
def token_search(spark, d):
    return t(spark, d, "documents").where(search.has_token(search.tokens(F.col("text")), "Idiot")).select("doc_id")


@query("""WITH a AS (SELECT lang, source, count(*) AS postings, count(*) FILTER (toxic = 1) AS required_count, round(avg(n_chars), 4) AS avg_pay FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source)
SELECT lang, source, postings, required_count, avg_pay, CAST(rank() OVER (PARTITION BY lang ORDER BY postings DESC) AS INTEGER) AS rank FROM a""")
def market_stats_rank(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    return skills.market_stats(rows, "lang", "source", F.coalesce(F.col("toxic") == 1, F.lit(False)), "n_chars")


QUERY_VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]), 4) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, d):
    return rank.top_k_cosine(t(spark, d, "embeddings"), F.array(*map(F.lit, QUERY_VECTOR)), 20)


RANKED = "SELECT vec_id, row_number() OVER (ORDER BY {0} DESC, vec_id) AS r FROM (SELECT vec_id, {1} AS {0} FROM embeddings) ORDER BY {0} DESC, vec_id LIMIT 50"


@query(f"""WITH a AS ({RANKED.format('s', f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}::DOUBLE[]), 4)")}), b AS ({RANKED.format('s', "round(CAST(embedding[1] AS DOUBLE), 4)")})
SELECT vec_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b USING (vec_id)""")
def hybrid_rrf(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "embeddings")
    place = lambda df: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))  # noqa: E731  50 rows
    near = place(rank.top_k_cosine(e, F.array(*map(F.lit, QUERY_VECTOR)), 50))
    word = place(e.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(50))
    return rank.fuse(near, word, "vec_id")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' AND value > 10 THEN 1 ELSE 0 END AS INTEGER) AS weight FROM events")
def interaction_weights(spark, d):
    action = F.when(F.col("event_type") == "purchase", "apply").when(F.col("event_type") == "click", "save").otherwise(F.col("event_type"))
    return t(spark, d, "events").select("event_id", rank.label_weight(action, F.col("value")).cast("int").alias("weight"))


@query("""WITH a AS (SELECT quality AS y, toxic AS s FROM labels), p AS (SELECT sum(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM (SELECT s, count(*) OVER () FROM a WHERE y = 1) x, (SELECT s FROM a WHERE y = 0) z)
SELECT round(CAST(w AS DOUBLE) / n, 6) AS auc FROM p""")
def auc_score(spark, d):
    return rank.auc(t(spark, d, "labels"), "toxic", "quality")


@query("SELECT doc_id, i AS chunk, array_to_string(w[i * 300 + 1 : i * 300 + 400], ' ') AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents), (SELECT unnest(range(20000)) AS i) WHERE i = 0 OR i * 300 + 100 < len(w)")
def chunk_windows(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(search.windows(F.col("text"))).alias("chunk", "words")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "words")


# Budgets, streams, synthetic postings


@query("SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS asked, least(count(*), 50) AS allowed, greatest(count(*) - 50, 0) AS refused FROM events GROUP BY ALL")
def daily_budget(spark, d):
    return ingest.daily_budget(t(spark, d, "events"), "event_type", "ts", 50)


@query("SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY user_id, event_type")
def stream_ingest_dedup(spark, d):
    """Two runs over the same files; the second finds nothing new."""
    base = shared_dir(spark)
    batch = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    batch.write.parquet(f"{base}/in")
    for name in ("first", "again"):
        ingest.run_available(ingest.stream(spark, f"{base}/in", batch.schema), f"{base}/checkpoint-{name}", ingest.append_new(f"{base}/{name if name == 'first' else 'first'}", ["user_id", "event_type"], ["ts", "event_id"]))
    return spark.read.schema(batch.schema).parquet(f"{base}/first").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def postings(spark, d) -> DataFrame:
    """As many synthetic postings as there are orders."""
    return synthetic.postings(spark, t(spark, d, "orders").count())


@query()
def synthetic_source(spark, d):
    return postings(spark, d).select("source_id", F.length("payload").alias("chars"), F.size("required").alias("n_required"))


@query()
def posting_pipeline(spark, d):
    """Synthetic postings through the whole plan: scrub, hash, flatten, contract, keep-last."""
    p = postings(spark, d)
    rows = raw.documents(p.select(F.col("idx").alias("id"), F.lit("sample").alias("source"), "source_id", F.lit("detail").alias("endpoint"), "payload", F.lit("2026-09-15 00:00:00").cast("timestamp").alias("fetched_at")))
    jobs = normalize.normalize(rows).jobs
    return jobs.select("source", "source_id", "company_name_normalized", "title", "exp_min", "salary_min", "education", "deadline")


@query()
def extraction_precision_recall(spark, d):
    """Skills extracted from synthetic postings, traps and all, against those that were written into them."""
    p = postings(spark, d)
    flat = normalize.flatten(p.select(F.lit("sample").alias("source"), "payload", F.col("idx").alias("id"), F.lit("2026-09-15 00:00:00").cast("timestamp").alias("fetched_at")))
    known = dictionary.skills(spark, [(s, "tool", [synthetic.ALIASES[s]] if s in synthetic.ALIASES else [], []) for s in synthetic.SKILLS])
    found = skills.extract(flat, known).groupBy(F.col("source_id").alias("key")).agg(F.collect_set("skill").alias("skills"))
    return skills.precision_recall(found, p.select(F.col("source_id").alias("key"), F.array_union("required", "preferred").alias("skills")))
