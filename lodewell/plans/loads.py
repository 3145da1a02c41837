"""More registered queries: loading, defaults and lifecycle of tables, dictionaries, skills per posting, matching and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.functions import maps, search
from lodewell.operators import load, rank, skills, tables
from lodewell.plans.queries import query, t
from lodewell.sources.dictionary import SCHEMA

# Loading

#: The 24 flat columns of a posting from an order, in SQL that both engines read; {0} is the engine's word for a text.
POSTING = """'sample' AS source, CAST(o_orderkey AS {0}) AS source_id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('회사', o_custkey) END AS company_name, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE concat('회사', o_custkey) END AS company_name_normalized,
CASE WHEN o_custkey % 2 = 0 THEN 'it' END AS industry_name, CAST(NULL AS {0}) AS size_category, CAST(NULL AS {0}) AS homepage, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('본문 ', o_orderstatus) END AS description, '[]' AS sections, o_orderstatus AS job_category,
CAST(NULL AS {0}) AS employment_type, CAST(o_orderkey % 9 AS SMALLINT) AS exp_min, CAST(NULL AS SMALLINT) AS exp_max, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'bachelor' END AS education, CAST(o_orderkey % 50 * 100000 AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, CAST(NULL AS {0}) AS salary_raw,
CAST(o_custkey % 5 AS {0}) AS region_code, CAST(NULL AS {0}) AS region_name, CAST(o_orderdate AS DATE) AS posted_at, CAST(NULL AS DATE) AS deadline, CAST(NULL AS {0}) AS url, CAST(NULL AS {0}) AS parse_flags"""
#: The second collection: every seventh title is new, every fifth company another one.
AGAIN = POSTING.replace("o_orderpriority AS title", "CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END AS title")


def posting(spark, d, form: str = POSTING) -> DataFrame:
    return t(spark, d, "orders").selectExpr(*[x.strip() for x in top_level(form.format("STRING"))])


def top_level(text: str) -> list[str]:
    """A select list cut at the commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def hashed_json(columns: str) -> str:
    """DuckDB SQL for the canonical JSON of the content fields."""
    parts = []
    for f in sorted(load.CONTENT_FIELDS):
        number = f in ("exp_min", "exp_max", "salary_min", "salary_max")
        value = f"CAST({f} AS VARCHAR)" if number else f"""'"' || CAST({f} AS VARCHAR) || '"'"""
        parts.append(f"""'"{f}":' || coalesce({value}, 'null')""")
    return f"sha256('{{' || {' || \',\' || '.join(parts)} || '}}') AS content_hash FROM {columns}"


@query(f"WITH p AS (SELECT {POSTING.format('VARCHAR')} FROM orders) SELECT source_id, {hashed_json('p')}")
def content_hash_16_fields(spark, d):
    rows = posting(spark, d)
    return load.job_rows(rows, load.no_companies(rows)).select("source_id", "content_hash")


def collected(spark, d) -> load.Loaded:
    """Two collections of postings, of which the first is loaded: a fifth of the postings is new, a fifth only in the first."""
    first = posting(spark, d).where("CAST(source_id AS BIGINT) % 10 < 8")
    second = posting(spark, d, AGAIN).where("CAST(source_id AS BIGINT) % 10 > 1")
    known = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("회사"), "c_custkey").alias("name"), F.concat(F.lit("회사"), "c_custkey").alias("name_normalized"), F.lit(None).cast("string").alias("biz_no"), F.lit("62").alias("industry_code"), F.lit("old").alias("industry_name"), F.lit("large").alias("size_category"), F.lit("x").alias("homepage"))
    companies = second.where("company_name_normalized <> ''").groupBy("company_name_normalized").agg(F.first("company_name").alias("company_name"), F.min("industry_name").alias("industry_name"), F.lit(None).cast("string").alias("size_category"), F.lit(None).cast("string").alias("homepage"))
    return load.load_normalized(known, load.job_rows(first, known), second, companies)


LOADED_SQL = f"""WITH a AS (SELECT {POSTING.format('VARCHAR')} FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT {AGAIN.format('VARCHAR')} FROM orders WHERE o_orderkey % 10 > 1),
k AS (SELECT c_custkey AS id, concat('회사', c_custkey) AS name FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT DISTINCT company_name_normalized AS name FROM b WHERE company_name_normalized <> ''),
i AS (SELECT id, name FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY name), name FROM n WHERE name NOT IN (SELECT name FROM k)),
m AS (SELECT coalesce(b.source_id, a.source_id) AS source_id, CASE WHEN b.source_id IS NULL THEN NULL WHEN a.source_id IS NULL THEN 'insert' WHEN a.title <> b.title THEN 'update' ELSE 'skip' END AS action, coalesce(b.title, a.title) AS title,
    CASE WHEN b.source_id IS NULL OR a.title = b.title THEN (SELECT id FROM k WHERE name = a.company_name_normalized) ELSE (SELECT id FROM i WHERE name = b.company_name_normalized) END AS company_id FROM a FULL JOIN b ON a.source_id = b.source_id)"""


@query(f"{LOADED_SQL} SELECT (SELECT count(*) FROM n) AS companies, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped FROM m")
def load_counts(spark, d):
    return collected(spark, d).result


@query(f"{LOADED_SQL} SELECT source_id, title, company_id, action FROM m")
def load_jobs(spark, d):
    return collected(spark, d).jobs.select("source_id", "title", "company_id", "action")


@query(f"{LOADED_SQL} SELECT i.id, i.name AS name_normalized, CASE WHEN k.id IS NOT NULL THEN '62' END AS industry_code, CASE WHEN n.name IS NULL THEN 'old' WHEN CAST(substr(i.name, 3) AS BIGINT) % 2 = 0 THEN 'it' END AS industry_name, CASE WHEN n.name IS NULL THEN 'large' END AS size_category FROM i LEFT JOIN k ON k.name = i.name LEFT JOIN n ON n.name = i.name")
def load_companies(spark, d):
    return collected(spark, d).companies.select("id", "name_normalized", "industry_code", "industry_name", "size_category")


# Tables


@query("SELECT CAST(l_orderkey AS BIGINT) AS job_id, CAST(l_linenumber AS INTEGER) AS skill_id, false AS is_required, CAST(1 AS INTEGER) AS occurrences, CAST(1 AS FLOAT) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'dict_v1' END AS extracted_by FROM lineitem")
def row_defaults(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("skill_id"), F.when(F.col("l_returnflag") == "R", "dict_v1").alias("extracted_by"))
    return tables.with_defaults(rows, "job_skills")


JOBS = "o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS deadline, o_orderpriority AS region_code, o_orderstatus AS job_category, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END AS exp_min, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 + 4 END AS exp_max"
TODAY = "DATE '1998-01-01'"


def open_jobs(spark, d) -> DataFrame:
    return t(spark, d, "orders").selectExpr(*top_level(JOBS))


@query(f"WITH j AS (SELECT {JOBS} FROM orders) SELECT o_orderkey, CASE WHEN status = 'open' AND deadline < {TODAY} THEN 'expired' ELSE status END AS status FROM j")
def expired_postings(spark, d):
    return tables.expire(open_jobs(spark, d), F.expr(TODAY)).select("o_orderkey", "status")


@query(f"WITH j AS (SELECT {JOBS} FROM orders) SELECT o_orderkey FROM j WHERE status = 'open' AND (deadline IS NULL OR deadline >= {TODAY}) AND region_code = '5-LOW' AND coalesce(exp_min, 0) <= 5 AND (exp_max IS NULL OR exp_max >= 5)")
def job_filters(spark, d):
    return tables.find_jobs(open_jobs(spark, d), status="open", until=F.expr(TODAY), region="5-LOW", years=5).select("o_orderkey")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN value ELSE event_id % 10 END AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS u, CAST(CASE WHEN event_type = 'error' THEN 3 ELSE 2 END AS INTEGER) AS keys FROM events")
def map_merge(spark, d):
    left = F.create_map(F.lit("k"), (F.col("event_id") % 10).cast("double"), F.lit("u"), F.col("user_id").cast("double"))
    right = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.col("value"), F.lit("v"), F.col("value"))).otherwise(F.create_map().cast("map<string,double>"))
    both = t(spark, d, "events").select("event_id", maps.merged(left, right).alias("m"))
    return both.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["u"].alias("u"), F.size("m").alias("keys"))


@query("""SELECT o_orderkey, '{"priority":"' || o_orderpriority || '","day":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","price":null}' AS text, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day FROM orders""")
def json_round_trip(spark, d):
    text = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"), F.lit(None).cast("double").alias("price")), {"ignoreNullFields": "false"})
    back = t(spark, d, "orders").select("o_orderkey", text.alias("text")).withColumn("x", F.from_json("text", "priority STRING, day DATE, price DOUBLE"))
    return back.select("o_orderkey", "text", "x.priority", "x.day")


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, 'idiot|password')), chr(10)) AS text FROM documents")
def negated_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", skills.without_negations(F.col("text"), "idiot|password").alias("text"))


# Dictionaries and skills


def nation_rows(spark, d, category) -> DataFrame:
    aliases = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lower("n_name"), F.lit("x"))))
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(category).alias("category"), aliases.alias("aliases"), F.lit(None).cast("array<string>").alias("match_patterns"))


@query("""SELECT n_name AS canonical_name, CASE WHEN n_nationkey >= 10 THEN 'cloud' ELSE 'tool' END AS category, CASE WHEN n_nationkey < 10 THEN 'old' WHEN n_nationkey % 2 = 0 THEN lower(n_name) || 'x' ELSE '' END AS aliases, n_nationkey >= 10 AS is_active, CASE WHEN n_nationkey < 10 THEN NULL WHEN n_nationkey < 15 THEN 'update' ELSE 'insert' END AS action FROM nation""")
def seed_dictionary(spark, d):
    target = nation_rows(spark, d, "tool").where("k < 15").select(F.col("name").alias("canonical_name"), "category", F.array(F.lit("old")).alias("aliases"), "match_patterns", F.lit(False).alias("is_active"))
    return load.seed_skills(target, nation_rows(spark, d, "cloud").where("k >= 10").drop("k")).select("canonical_name", "category", F.array_join("aliases", ",").alias("aliases"), "is_active", "action")


FAULTY = "CASE WHEN n_nationkey % 5 = 0 THEN 'NATION_1' ELSE n_name END AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'metal' WHEN n_nationkey % 7 = 0 THEN NULL ELSE 'tool' END AS category"


@query(f"""WITH s AS (SELECT {FAULTY}, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'Shared' ELSE 'a' || n_nationkey END AS alias FROM nation)
SELECT 'duplicate_name' AS problem, name FROM s GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'unknown_category', name FROM s WHERE category IS NULL OR category <> 'tool'
UNION ALL SELECT 'alias_taken', lower(alias) FROM s GROUP BY lower(alias) HAVING count(*) > 1 UNION ALL SELECT 'alias_is_name', name FROM s WHERE lower(alias) = lower(name)""")
def dictionary_validation(spark, d):
    n = t(spark, d, "nation")
    alias = F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 4 == 1, "Shared").otherwise(F.concat(F.lit("a"), "n_nationkey"))
    rows = n.selectExpr(*top_level(FAULTY), "n_nationkey", "n_name").select("name", "category", F.array(alias).alias("aliases"), F.array().cast("array<string>").alias("match_patterns"))
    return skills.validate(spark.createDataFrame([], SCHEMA).unionByName(rows))


FOUND = "SELECT l_orderkey, l_linestatus || (l_suppkey % 8) AS skill, count(*) AS occurrences FROM lineitem WHERE l_returnflag = '{0}' GROUP BY ALL"
JOB_SKILLS_SQL = f"WITH b AS ({FOUND.format('R').replace('SELECT l', 'SELECT true AS q, l')} UNION ALL {FOUND.format('A').replace('SELECT l', 'SELECT false AS q, l')}), j AS (SELECT l_orderkey, skill, bool_or(q) AS is_required, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM b GROUP BY ALL)"


def found_skills(spark, d) -> DataFrame:
    lines = t(spark, d, "lineitem")
    hits = lines.where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", F.concat("l_linestatus", F.col("l_suppkey") % 8).alias("skill"), (F.col("l_returnflag") == "R").alias("is_required"), F.lit(1).cast("long").alias("occurrences"))
    return skills.united(hits, "l_orderkey", confidence=F.when(F.col("is_required"), 1.0).otherwise(0.5), partitions=skills.shares(lines, lines.count()))


@query(f"{JOB_SKILLS_SQL} SELECT l_orderkey, skill, is_required, occurrences, CAST(CASE WHEN is_required THEN 1 ELSE 0.5 END AS FLOAT) AS confidence, 'dict_v1' AS extracted_by FROM j")
def job_skills(spark, d):
    return found_skills(spark, d)


@query(f"{JOB_SKILLS_SQL} SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM j WHERE skill = 'F3' AND is_required)")
def jobs_requiring_skill(spark, d):
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return skills.jobs_with(jobs, found_skills(spark, d), "l_orderkey", "F3").select(F.col("l_orderkey").alias("o_orderkey"), "o_orderpriority")


@query("""WITH f AS (SELECT l_suppkey AS k, list_distinct(list(l_linenumber)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY k), g AS (SELECT l_suppkey AS k, list_distinct(list(l_linenumber)) AS s FROM lineitem WHERE l_quantity < 10 GROUP BY k),
j AS (SELECT coalesce(len(f.s), 0) AS nf, coalesce(len(g.s), 0) AS ng, coalesce(len(list_intersect(f.s, g.s)), 0) AS hit FROM f FULL JOIN g USING (k))
SELECT round(CAST(sum(hit) AS DOUBLE) / sum(nf), 4) AS precision, round(CAST(sum(hit) AS DOUBLE) / sum(ng), 4) AS recall FROM j""")
def precision_recall(spark, d):
    of = lambda condition: t(spark, d, "lineitem").where(condition).groupBy(F.col("l_suppkey").alias("key")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("skills"))
    return skills.precision_recall(of("l_returnflag = 'R'"), of("l_quantity < 10"))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_orderpriority, count(*) AS postings, count(*) FILTER (o_custkey % 2 = 0) AS required_count, round(avg(o_totalprice), 4) AS avg_pay FROM orders GROUP BY ALL)
SELECT day, o_orderstatus, o_orderpriority, postings, required_count, avg_pay, CAST(rank() OVER (PARTITION BY day, o_orderstatus ORDER BY postings DESC) AS INTEGER) AS rank FROM a""")
def market_stats_daily(spark, d):
    rows = t(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return skills.market_stats(rows, ["day", "o_orderstatus"], "o_orderpriority", F.col("o_custkey") % 2 == 0, "o_totalprice")


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS demand FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey ORDER BY demand DESC, l_partkey LIMIT 10")
def skill_gap_topn(spark, d):
    held = t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return skills.skill_gap(t(spark, d, "lineitem"), held, "l_partkey", 10)


# Search, matching, evaluation

GRAMS = "list_distinct(list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3)))"


@query(f"""WITH a AS (SELECT p_partkey, '  ' || lower(p_name) || ' ' AS x FROM part), g AS (SELECT p_partkey, {GRAMS} AS g FROM a), w AS (SELECT {GRAMS} AS w FROM (SELECT '  smal rings ' AS x))
SELECT p_partkey, round(CAST(len(list_intersect(g, w)) AS DOUBLE) / len(list_distinct(list_concat(g, w))), 6) AS similarity FROM g, w WHERE CAST(len(list_intersect(g, w)) AS DOUBLE) / len(list_distinct(list_concat(g, w))) >= 0.3""")
def trigram_search(spark, d):
    s = t(spark, d, "part").select("p_partkey", search.trigram_similarity(F.col("p_name"), F.lit("smal rings")).alias("similarity"))
    return s.where("similarity >= 0.3").select("p_partkey", F.round("similarity", 6).alias("similarity"))


#: Columns of a pair of a profile (a customer) and a posting (one of the customer's orders); lists and maps come beside.
PAIR = "o_orderkey, CAST(o_custkey % 12 AS DOUBLE) AS years, CASE o_custkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'highschool' END AS profile_education, CAST(o_custkey % 4 * 1000 AS BIGINT) AS desired_salary, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END AS exp_min, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 + 2 END AS exp_max, CASE o_orderkey % 3 WHEN 0 THEN 'bachelor' WHEN 1 THEN 'highschool' END AS education, o_orderstatus AS region_code, CAST(o_orderkey % 5000 AS BIGINT) AS salary_min, o_orderkey % 100 AS views, CAST(o_orderdate AS DATE) AS deadline"
ROUNDED = ("skill_required_coverage", "skill_preferred_coverage", "skill_weighted_score", "exp_fit", "salary_gap_ratio", "semantic_similarity", "title_similarity", "job_popularity")


@query(f"""WITH p AS (SELECT {PAIR}, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS skill_required_coverage, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS skill_preferred_coverage,
    round(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 * 2 / 3 ELSE 0 END::DOUBLE, 6) AS skill_weighted_score, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS missing_required_count, years - exp_min AS exp_gap,
    round(exp(-(CASE WHEN years < coalesce(exp_min, 0) THEN coalesce(exp_min, 0) - years WHEN years > exp_max THEN years - exp_max ELSE 0 END) / 3.0::DOUBLE), 6) AS exp_fit,
    CAST(CASE WHEN education IS NULL OR profile_education = 'master' OR (profile_education = 'highschool' AND education = 'highschool') THEN 1 ELSE 0 END AS INTEGER) AS education_fit, CAST(CASE WHEN region_code IN ('F', 'O') THEN 1 ELSE 0 END AS INTEGER) AS region_match,
    round(CASE WHEN desired_salary > 0 THEN CAST(salary_min - desired_salary AS DOUBLE) / desired_salary END, 6) AS salary_gap_ratio, 0.6::DOUBLE AS semantic_similarity, 1.0::DOUBLE AS title_similarity, round(ln(1 + views::DOUBLE), 6) AS job_popularity, CAST(date_diff('day', {TODAY}, deadline) AS INTEGER) AS days_until_deadline FROM p""")
def match_features(spark, d):
    even, texts = F.col("o_orderkey") % 2 == 0, lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    pairs = t(spark, d, "orders").selectExpr(*top_level(PAIR), "o_custkey").withColumns(
        {
            "held": F.when(F.col("o_custkey") % 2 == 0, texts("a", "p")).otherwise(texts("a", "z")), "levels": F.create_map(F.lit("a"), F.lit(0.5)), "wanted_regions": texts("F", "O"), "profile_vector": F.array(F.lit(1.0), F.lit(0.0)), "wanted_title": F.lit("backend developer"),
            "required": F.when(even, texts("a", "b")).otherwise(texts("b", "c")), "preferred": F.when(F.col("o_orderkey") % 5 == 0, texts()).otherwise(texts("p")), "weights": F.when(even, F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))).otherwise(F.create_map(F.lit("b"), F.lit(1.0))),
            "job_vector": F.array(F.lit(0.6), F.lit(0.8)), "title": F.lit("Backend developer"),
        }
    )
    made = rank.features(F.expr(TODAY))
    return pairs.select("o_orderkey", *[(F.round(v, 6) if k in ROUNDED else v).alias(k) for k, v in made.items()])


VECTOR = [((i * 29) % 13 - 6) / 10 for i in range(64)]
CANDIDATE = "vec_id, embedding, CAST(label % 4 AS {0}) AS region_code, CAST(label % 3 AS {0}) AS job_category, vec_id % 9 AS exp_min, vec_id % 9 + 3 AS exp_max"


@query(f"""WITH c AS (SELECT {CANDIDATE.format('VARCHAR')} FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VECTOR}::DOUBLE[]), 4) AS similarity FROM c WHERE region_code IN ('0', '1') AND exp_min <= 5 AND exp_max >= 5 ORDER BY similarity DESC, vec_id LIMIT 50""")
def candidate_stage(spark, d):
    rows = t(spark, d, "embeddings").selectExpr(*top_level(CANDIDATE.format("STRING")))
    return rank.candidates(rows, F.array(*map(F.lit, VECTOR)), regions=("0", "1"), years=5, k=50)


@query("""WITH a AS (SELECT lang, d.doc_id, n_chars AS s, quality + 2 * toxic AS g FROM documents d JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, doc_id) AS i, row_number() OVER (PARTITION BY lang ORDER BY g DESC, doc_id) AS j, CAST(count(*) FILTER (g > 0) OVER (PARTITION BY lang ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c FROM a)
SELECT lang, round(sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) / nullif(sum(CASE WHEN j <= 10 THEN g / log2(j + 1) ELSE 0 END), 0), 4) AS ndcg, round(CAST(count(*) FILTER (i <= 10 AND g > 0) AS DOUBLE) / nullif(count(*) FILTER (g > 0), 0), 4) AS recall,
    round(coalesce(sum(CASE WHEN i <= 10 AND g > 0 THEN c / i END), 0) / nullif(least(count(*) FILTER (g > 0), 10), 0), 4) AS map FROM r GROUP BY lang""")
def ranking_metrics(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id").withColumn("gain", F.col("quality") + 2 * F.col("toxic"))
    return rank.ranking_metrics(rows, "lang", "n_chars", "gain", tie="doc_id")


@query("""WITH w AS (SELECT doc_id, s, list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda v: v <> '') AS w FROM (SELECT doc_id, unnest(['text', 'source']) AS s, unnest([text, source]) AS x FROM documents))
SELECT doc_id, s AS section, i AS chunk, array_to_string(w[i * 300 + 1 : i * 300 + 400], ' ') AS words FROM w, (SELECT unnest(range(20000)) AS i) WHERE (i = 0 OR i * 300 + 100 < len(w)) AND len(w) > 0""")
def section_chunks(spark, d):
    return search.section_chunks(t(spark, d, "documents"), "doc_id", ["text", "source"])
