"""Merges, raw layer, constraints, skills and ranking."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodewell.operators import dedup, load, merge, quality, rank, raw, skills, tables
from lodewell.schemas import TABLES
from lodewell.sources.dictionary import skills as dictionary


def test_merge_actions(spark):
    target = spark.createDataFrame([(1, "a", "x", "keep"), (2, "b", None, "keep"), (3, "c", "z", "keep")], "id int, h string, v string, extra string")
    source = spark.createDataFrame([(1, "a", "other"), (2, None, None), (4, "d", "w")], "id int, h string, v string")
    got = {r.id: (r.v, r.extra, r.action) for r in merge.merge(target, source, ["id"], hash_column="h").collect()}
    assert got == {1: ("x", "keep", "skip"), 2: (None, "keep", "update"), 3: ("z", "keep", None), 4: ("w", None, "insert")}


def test_snapshots_are_never_overwritten(spark, tmp_path):
    path = merge.write_snapshot(spark.range(3), f"file://{tmp_path}", 1)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        merge.write_snapshot(spark.range(4), f"file://{tmp_path}", 1)


def test_merge_is_idempotent(spark):
    source = spark.range(600).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    first = merge.merge(source.limit(0), source, ["id"], hash_column="h")
    assert merge.tally(first).first().asDict() == {"inserted": 600, "updated": 0, "skipped": 0}
    again = merge.merge(first.drop("action"), source, ["id"], hash_column="h")
    assert merge.tally(again).first().asDict() == {"inserted": 0, "updated": 0, "skipped": 600}


def test_null_overwrites_and_insert_only(spark):
    target = spark.createDataFrame([(1, "a", "old")], "id int, v string, flags string")
    source = spark.createDataFrame([(1, None, "new")], "id int, v string, flags string")
    r = merge.merge(target, source, ["id"], insert_only=("flags",)).first()
    assert (r.v, r.flags, r.action) == (None, "old", "update")


def test_surrogate_ids(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("z", 7)], "name string, id long")
    assert {r.name: r.id for r in merge.with_surrogate_ids(df, "id", ["name"]).collect()} == {"z": 7, "a": 8, "b": 9}


def test_insert_ignore(spark):
    docs = spark.createDataFrame([(i, "s", str(i % 10)) for i in range(20)], "n int, source string, h string")
    first = dedup.insert_ignore(docs.limit(0), docs, ["source", "h"], ["n"])
    assert sorted(r.n for r in first.collect()) == list(range(10))
    assert dedup.insert_counts(first, docs, ["source", "h"], ["n"]).first().asDict() == {"fetched": 20, "inserted": 0, "duplicates": 20}


def test_pending_and_mark(spark):
    rows = [(i, "s", str(i // 2), "detail" if i % 2 else "list", "{}", datetime(2026, 1, 1 + i % 3), None) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, source string, source_id string, endpoint string, payload string, fetched_at timestamp, processed_at timestamp")
    p = raw.pending(df, "s", 2)
    assert [r.id for r in p.collect()] == [3, 1]
    marked = raw.mark_processed(df, "s", p, F.lit("2026-02-01").cast("timestamp"))
    assert sorted(r.id for r in marked.where("processed_at IS NOT NULL").collect()) == [0, 1, 2, 3]
    assert raw.pending(marked, "s").count() == 1
    assert raw.reset(marked, "s").where("processed_at IS NOT NULL").count() == 0
    one = raw.mark_processed(df, "s", p, F.lit("2026-02-01").cast("timestamp"), by="id")
    assert sorted(r.id for r in one.where("processed_at IS NOT NULL").collect()) == [1, 3]


def test_surrogate_ids_of_many_partitions(spark):
    """More rows than one partition holds, whose counts and numbers are two executions."""
    rows = spark.range(60_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.lit("x" * 50).alias("v"), F.lit(None).cast("long").alias("id"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = merge.with_surrogate_ids(rows, "id", ["name"])
        assert got.count() == 60_000 and got.where("id <> cast(substr(name, 2) AS long) + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


JOB_ROWS = [("s", "1", "(주)가", "가", "it", "big", None, "t1", "d", "x", "dev", None, 1, 3, None, 30_000_000, None, "r", "11", "서울", None, None, "u", "p"), ("s", "2", "나", "나", "it", None, None, "t2", None, "x", "dev", None, None, None, None, None, None, "r", "11", "서울", None, None, "u", None), ("s", "3", None, "", None, None, None, "t3", None, "x", None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
JOB_SCHEMA = "source string, source_id string, company_name string, company_name_normalized string, industry_name string, size_category string, homepage string, title string, description string, sections string, job_category string, employment_type string, exp_min short, exp_max short, education string, salary_min long, salary_max long, salary_raw string, region_code string, region_name string, posted_at date, deadline date, url string, parse_flags string"


def test_load_normalized(spark):
    jobs = spark.createDataFrame(JOB_ROWS, JOB_SCHEMA)
    companies = jobs.where("company_name_normalized <> ''").select("company_name", "company_name_normalized", "industry_name", "size_category", "homepage")
    none = load.no_companies(jobs)
    empty = load.job_rows(jobs, none).limit(0)
    first = load.load_normalized(none, empty, jobs, companies)
    assert first.result.first().asDict() == {"companies": 2, "inserted": 3, "updated": 0, "skipped": 0}
    ids = {r.name_normalized: r.id for r in first.companies.collect()}
    assert ids == {"가": 1, "나": 2} and {r.source_id: r.company_id for r in first.jobs.collect()} == {"1": 1, "2": 2, "3": None}
    stored, known = first.jobs.drop("action"), first.companies
    assert load.load_normalized(known, stored, jobs, companies).result.first().asDict() == {"companies": 2, "inserted": 0, "updated": 0, "skipped": 3}
    changed = jobs.withColumns({"title": F.when(F.col("source_id") == "1", "new").otherwise(F.col("title")), "parse_flags": F.lit("other"), "company_name_normalized": F.when(F.col("source_id") == "2", "가").otherwise(F.col("company_name_normalized"))})
    second = load.load_normalized(known, stored, changed, companies)
    got = {r.source_id: (r.title, r.parse_flags, r.company_id, r.action) for r in second.jobs.collect()}
    assert got == {"1": ("new", "p", 1, "update"), "2": ("t2", None, 2, "skip"), "3": ("t3", None, None, "skip")}


def test_seed_skills(spark):
    target = spark.createDataFrame([("Go", "tool", ["x"], None, False), ("C", "language", [], None, True)], "canonical_name string, category string, aliases array<string>, match_patterns array<string>, is_active boolean")
    rows = spark.createDataFrame([("Go", "language", None, ["[Gg]o"]), ("Rust", "language", ["rs"], None)], "name string, category string, aliases array<string>, match_patterns array<string>")
    got = {r.canonical_name: (r.category, r.aliases, r.is_active, r.action) for r in load.seed_skills(target, rows).collect()}
    assert got == {"Go": ("language", [], True, "update"), "C": ("language", [], True, None), "Rust": ("language", ["rs"], True, "insert")}
    with pytest.raises(ValueError, match="unknown_category: X"):
        load.seed_skills(target, rows.unionByName(rows.limit(1).withColumns({"name": F.lit("X"), "category": F.lit("metal")})))


def test_tables(spark, tmp_path):
    tables.create_tables(spark, "made")
    try:
        assert {r.tableName for r in spark.sql("SHOW TABLES IN made").collect()} == set(TABLES) and spark.table("made.jobs").count() == 0
        tables.create_tables(spark, "made")
    finally:
        tables.drop_tables(spark, "made")
        spark.sql("DROP DATABASE made")
    row = tables.with_defaults(spark.createDataFrame([(1, None)], "id long, status string"), "jobs", F.lit("2026-01-01").cast("timestamp")).first()
    assert row.status is None and row.created_at == datetime(2026, 1, 1) and row.title is None
    assert tables.with_defaults(spark.createDataFrame([("Go",)], "canonical_name string"), "skills").first().aliases == []
    jobs = spark.createDataFrame([(1, "open", date(2026, 1, 1), "11", "dev", 1, 3), (2, "open", None, "11", "dev", None, None), (3, "closed", date(2026, 1, 1), "26", "ops", 5, None), (4, "open", date(2026, 3, 1), "11", "ops", 2, 8)], "id int, status string, deadline date, region_code string, job_category string, exp_min int, exp_max int")
    today = F.lit("2026-02-01").cast("date")
    assert {r.id: r.status for r in tables.expire(jobs, today).collect()} == {1: "expired", 2: "open", 3: "closed", 4: "open"}
    find = lambda **k: sorted(r.id for r in tables.find_jobs(jobs, **k).collect())
    assert find(status="open", until=today) == [2, 4] and find(region="11", category="dev") == [1, 2] and find(years=4) == [2, 4]
    tables.write_layout(jobs, f"file://{tmp_path}/jobs")
    back = spark.read.parquet(f"file://{tmp_path}/jobs").where("status = 'open' AND region_code = '11'")
    assert back.count() == 3 and "PartitionFilters: [isnotnull(status" in back._jdf.queryExecution().toString()


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (-1, None), (None, None), (1, 0)], "a int, b int")
    got = {r.check_name: r.violations for r in quality.check_violations(df, {"a": F.col("a") >= 0, "b": F.col("b") >= F.col("a")}).collect()}
    assert got == {"a": 1, "b": 1} and quality.violating(df, F.col("a") >= 0).count() == 1
    assert [tuple(r) for r in quality.unique_violations(df, ["a"]).collect()] == [(1, 2)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert sorted(str(r.a) for r in quality.orphans_to_null(df, "a", parent, "id").collect()) == ["1", "1", "None", "None"]
    assert quality.cascade(df, "a", parent, "id").count() == 2


def test_dictionary_faults(spark):
    df = dictionary(spark, [("Python", "language", ["py", "PYTHON"], []), ("Java", "language", ["py"], []), ("Java", None, [], [])])
    assert {(r.problem, r.name) for r in skills.validate(df).collect()} == {("duplicate_name", "Java"), ("unknown_category", "Java"), ("alias_taken", "py"), ("alias_is_name", "Python")}


def test_skill_matching(spark):
    texts = spark.createDataFrame([(1, "Go 개발, golang. R&D 조직"), (2, "R 언어와 Node.js, py."), (3, None)], "id int, text string")
    found = skills.match_patterns(texts, "id", "text", {"R": "(?<![A-Za-z&+#])R(?![A-Za-z&+#])", "Go": "(?<![A-Za-z])[Gg]o(?:lang)?(?![A-Za-z])"})
    assert {(r.id, r.skill, r.occurrences) for r in found.collect()} == {(1, "Go", 2), (2, "R", 1)}
    words = skills.match_words(texts, "id", "text", dictionary(spark, [("Node.js", "framework", ["node"], []), ("Python", "language", ["py"], [])]))
    assert {(r.id, r.skill, r.occurrences) for r in words.collect()} == {(2, "Node.js", 1), (2, "Python", 1)}
    long = skills.match_words(spark.createDataFrame([(1, "Apache  Kafka; C# and machine learning. Machine"), (2, "")], "id int, text string"), "id", "text", dictionary(spark, [("Kafka", "tool", ["apache kafka"], []), ("C#", "language", [], []), ("ML", "domain", ["Machine Learning"], [])]))
    assert {(r.id, r.skill, r.occurrences) for r in long.collect()} == {(1, "Kafka", 2), (1, "C#", 1), (1, "ML", 1)}
    j = skills.job_skills(found, words, "id")
    assert {(r.confidence, r.extracted_by) for r in j.collect()} == {(1.0, "dict_v1")}
    jobs = spark.createDataFrame([(1,), (2,)], "id int")
    assert [r.id for r in skills.jobs_with(jobs, j, "id", "R").collect()] == [2] and skills.jobs_with(jobs, j, "id", "Python").count() == 0 and skills.jobs_with(jobs, j, "id", "Python", None).count() == 1
    assert [r.name for r in skills.by_alias(dictionary(spark, [("Python", "language", ["Py"], [])]), "PY").collect()] == ["Python"]
    assert {(r.id, r.skill, r.is_required) for r in j.collect()} == {(1, "Go", True), (2, "R", True), (2, "Node.js", False), (2, "Python", False)}


def test_extraction_passes_traps_over(spark):
    known = dictionary(spark, [("Java", "language", [], []), ("Python", "language", ["파이썬"], []), ("R", "language", [], ["(?<![A-Za-z&])R(?![A-Za-z&])"])])
    jobs = spark.createDataFrame([("1", ("파이썬 개발\nJava 경험은 필수가 아닙니다", "R&D 조직", "R 우대")), ("2", (None, None, "Python 경험 무관"))], "source_id string, sections struct<main_tasks:string,requirements:string,preferred:string>")
    assert {(r.source_id, r.skill, r.is_required) for r in skills.extract(jobs, known).collect()} == {("1", "Python", True), ("1", "R", False)}


def test_ranking(spark):
    df = spark.createDataFrame([("q", 3.0, 1), ("q", 2.0, 0), ("q", 1.0, 2)], "g string, s double, rel int")
    m = rank.ranking_metrics(df, "g", "s", "rel").first()
    assert m.ndcg == pytest.approx((1 + 2 / 2) / (2 + 1 / 1.584963), abs=1e-4) and m.recall == 1.0
    a = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert rank.auc(a, "s", "y").first().auc == 0.75
    assert m.map == pytest.approx((1 + 2 / 3) / 2, abs=1e-4)
    many = spark.range(3_000).select((F.col("id") % 700 / 7).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = [(r.s, r.y) for r in many.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert rank.auc(many, "s", "y").first().auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), abs=1e-6)
    f = spark.createDataFrame([(1, ["a", "b"], [], ["b", "c"])], "i int, r array<string>, p array<string>, h array<string>")
    r = f.select(*rank.match_features(F.col("r"), F.col("p"), F.col("h"))).first()
    assert (r.required_share, r.preferred_share, r.missing_required) == (0.5, 1.0, ["a"])


def test_features_candidates_and_reasons(spark):
    pair = spark.createDataFrame(
        [(1, ["a", "b"], {"a": 0.5}, 2.0, "bachelor", ["11"], 40, [1.0, 0.0], "backend", ["a", "c"], [], {"a": 2.0, "c": 1.0}, 3, 5, "college", "11", 50, [1.0, 0.0], "backend", 0, date(2026, 1, 11))],
        "id int, held array<string>, levels map<string,double>, years double, profile_education string, wanted_regions array<string>, desired_salary int, profile_vector array<double>, wanted_title string, required array<string>, preferred array<string>, weights map<string,double>, exp_min int, exp_max int, education string, region_code string, salary_min int, job_vector array<double>, title string, views int, deadline date",
    )
    made = rank.features(F.lit("2026-01-01").cast("date"))
    r = pair.select("id", *[v.alias(k) for k, v in made.items()]).first().asDict()
    assert len(made) == 13 and r.pop("exp_fit") == pytest.approx(math.exp(-1 / 3))
    assert r == {"id": 1, "skill_required_coverage": 0.5, "skill_preferred_coverage": 1.0, "skill_weighted_score": pytest.approx(1 / 3), "missing_required_count": 1, "exp_gap": -1.0, "education_fit": 1, "region_match": 1, "salary_gap_ratio": 0.25, "semantic_similarity": 1.0, "title_similarity": 1.0, "job_popularity": 0.0, "days_until_deadline": 10}
    s = rank.weighted(pair.select("id", *[v.alias(k) for k, v in made.items()]), {"skill_required_coverage": 2.0, "salary_gap_ratio": 1.0}, "id").first()
    assert s.score == 1.25 and [(x.feature, x.part) for x in s.reasons] == [("skill_required_coverage", 1.0), ("salary_gap_ratio", 0.25)]
    jobs = spark.createDataFrame([(i, [float(i), 1.0], "11" if i % 2 else "26", "dev", 1, 9) for i in range(8)], "vec_id int, embedding array<double>, region_code string, job_category string, exp_min int, exp_max int")
    near = rank.candidates(jobs, F.array(F.lit(1.0), F.lit(0.0)), regions=("11",), years=3, k=2)
    assert [r.vec_id for r in near.collect()] == [7, 5]


def test_extraction_takes_postings_once(spark, monkeypatch):
    """Both parts come from one pass, whatever sizes the optimizer takes, and dictionaries that are listed, broadcast or joined give the same rows."""
    from lodewell.operators import normalize
    from lodewell.sources import synthetic

    p = synthetic.postings(spark, 300)
    flat = normalize.flatten(p.select(F.lit("sample").alias("source"), "payload", F.col("idx").alias("id"), F.lit("2026-09-15 00:00:00").cast("timestamp").alias("fetched_at")))
    known = dictionary(spark, [(s, "tool", [synthetic.ALIASES[s]] if s in synthetic.ALIASES else [], []) for s in synthetic.SKILLS])
    rows = lambda: sorted(tuple(r) for r in skills.extract(flat, known).collect())
    found = skills.extract(flat, known)
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Range (") == 1 and "BuildLeft" not in plan.executedPlan().toString()
    got = rows()
    assert {r[1] for r in got} == set(synthetic.SKILLS)
    monkeypatch.setattr(skills, "MOST_LISTED", 0)
    assert rows() == got
    monkeypatch.setattr(skills, "MOST_BROADCAST", 0)
    assert rows() == got
    assert synthetic.postings(spark, 600_001).rdd.getNumPartitions() == 4 and synthetic.postings(spark, 2_000_001).rdd.getNumPartitions() == 9


def test_job_skills_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """A task has as many rows whatever the input's size, not a fixed share of them; and a posting's rows meet."""
    hits = spark.range(4_000).select((F.col("id") % 1_000).alias("job"), F.lit("Go").alias("skill"), (F.col("id") < 1_000).alias("is_required"), F.lit(1).cast("long").alias("occurrences"))
    monkeypatch.setattr(skills, "ROWS", 100)
    n = skills.shares(hits, 4_000)
    found = skills.united(hits, "job", partitions=n)
    assert n == 40 == found.rdd.getNumPartitions() and skills.shares(hits, 10) == 4
    assert found.count() == 1_000 == found.where("is_required AND occurrences = 4").count()
