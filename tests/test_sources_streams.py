"""Paged and synthetic sources, budgets, streams."""

import sys
from datetime import UTC, datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodewell.operators.ingestion import RunTable, raw_rows, run_ingestion
from lodewell.operators.raw import BudgetExceeded
from lodewell.session import Settings, healthy, jdbc_url
from lodewell.sources import synthetic
from lodewell.sources.dictionary import load_skills, load_vocabulary
from lodewell.sources.paged import CallBudget, ListQuery, PagedSource, PageSource, RawDocument, fetch_detail, has_next, plan_pages
from lodewell.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


class Numbers(PageSource):
    def __init__(self, n):
        self.n = n

    def total(self):
        return self.n

    def page(self, number, size):
        return [(str(i), "{}") for i in range((number - 1) * size, min(self.n, number * size))]


def test_paging():
    assert plan_pages(Numbers(250), ListQuery(page_size=100)) == [1, 2, 3]
    assert has_next(2, 100, 250) and not has_next(3, 100, 250)
    assert ListQuery(page_size=999).size(Numbers(1)) == 100
    assert plan_pages(Numbers(250), ListQuery(max_pages=2)) == [1, 2] and plan_pages(Numbers(0), ListQuery()) == []


def test_paged_source(spark):
    PagedSource.register(spark, "numbers", lambda options: Numbers(int(options.get("total", 0))))
    df = spark.read.format("numbers").option("total", 250).option("pageSize", 100).load()
    assert df.count() == 250 and df.rdd.getNumPartitions() == 3
    assert spark.read.format("numbers").load().count() == 0


def test_budget():
    now = [datetime(2026, 1, 1, tzinfo=UTC)]
    b = CallBudget(3, lambda: now[0])
    b.consume("s", 2)
    with pytest.raises(BudgetExceeded):
        b.consume("s", 2)
    assert b.used("s") == 2
    now[0] = datetime(2026, 1, 2, tzinfo=UTC)
    assert b.used("s") == 0
    with pytest.raises(BudgetExceeded):
        plan_pages(Numbers(1_000), ListQuery(page_size=100), b)
    free = CallBudget()
    free.consume("s", 1_000)
    assert free.used("s") == 1_000


def test_synthetic_is_deterministic_and_distributed_as_stated(spark):
    a, b = synthetic.postings(spark, 2_000), synthetic.postings(spark, 2_000).repartition(7)
    digest = lambda df: df.agg(F.sum(F.xxhash64("source_id", "payload").cast("decimal(38,0)"))).first()[0]
    assert digest(a) == digest(b) != digest(synthetic.postings(spark, 2_000, seed=1))
    seoul = a.where(F.get_json_object("payload", "$.wantedInfo.regionCd") == "11000").count() / 2_000
    open_ended = a.where(F.get_json_object("payload", "$.wantedInfo.receiptCloseDt").rlike("상시|채용시")).count() / 2_000
    assert seoul == pytest.approx(0.55, abs=0.04) and open_ended == pytest.approx(0.30, abs=0.04)


def test_ordinal_particles_and_typos(spark):
    df = spark.createDataFrame([("SAMPLE-000009",), ("SAMPLE-000010",), ("x",), ("SAMPLE-9",)], "s string")
    assert [r.n for r in df.select(synthetic.ordinal(F.col("s"), 10).alias("n")).collect()] == [9, None, None, None]
    w = spark.createDataFrame([("서버",), ("백엔드",), ("개발",), ("AWS",), ("Java",), ("K8",)], "w string")
    assert [r.x for r in w.select(synthetic.with_particle(F.col("w"), "을", "를").alias("x")).collect()] == ["서버를", "백엔드를", "개발을", "AWS을", "Java를", "K8을"]
    t = spark.createDataFrame([("Python",), ("Go",), ("파이썬자바",)], "w string").select(synthetic.typo(F.col("w"), F.lit(0.3)).alias("x"))
    got = [r.x for r in t.collect()]
    assert sorted(got[0]) == sorted("Python") and got[0] != "Python" and got[1:] == ["Go", "파이썬자바"]


def test_yaml_dictionary(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "skills.yaml"
    path.write_text("skills:\n  - {name: Go, category: language, aliases: [golang], patterns: ['[Gg]o']}\n  - {name: PHP, category: language}\n")
    assert [tuple(r) for r in load_skills(spark, str(path)).orderBy("name").collect()] == [("Go", "language", ["golang"], ["[Gg]o"]), ("PHP", "language", [], [])]


def test_stream_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    rows.write.parquet(f"file://{tmp_path}/in")
    write = ingest.append_new(f"file://{tmp_path}/out", ["k"], ["id"])
    for run in ("one", "two"):  # the second reads the same files anew
        ingest.run_available(ingest.stream(spark, f"file://{tmp_path}/in", rows.schema), f"file://{tmp_path}/checkpoint-{run}", write)
        assert sorted((r.id, r.k) for r in spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/out").collect()) == [(1, "a"), (3, "b")]


def test_distinct_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2026, 1, 1)), (1, datetime(2026, 1, 1, 1)), (2, datetime(2026, 1, 1))], "k int, ts timestamp")
    rows.write.parquet(f"file://{tmp_path}/in")
    got = []
    ingest.run_available(ingest.distinct_stream(ingest.stream(spark, f"file://{tmp_path}/in", rows.schema), ["k"], "ts"), f"file://{tmp_path}/c", lambda b, i: got.extend(r.k for r in b.collect()))
    assert sorted(got) == [1, 2]


def test_daily_budget(spark):
    calls = spark.createDataFrame([(i, "s", datetime(2026, 1, 1 + i // 4), c) for i, c in enumerate([2, 2, 1, 1, 3, 1])], "i int, source string, ts timestamp, cost int")
    by = {r.day.day: (r.asked, r.allowed, r.refused) for r in ingest.daily_budget(calls, "source", "ts", 3).collect()}
    assert by == {1: (4, 3, 1), 2: (2, 2, 0)}
    ok = {r.i: r.allowed for r in ingest.allowed_calls(calls, "source", "ts", ["i"], "cost", 3).collect()}
    assert ok == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_settings(spark):
    assert jdbc_url("jobs", "db", "5433") == "jdbc:postgresql://db:5433/jobs"
    assert Settings(shuffle_partitions="12").conf()["spark.sql.shuffle.partitions"] == "12" and healthy(spark)["status"] == "ok"


class Postings(Numbers):
    """Lists with details; contact data in both."""

    name = "made"

    def page(self, number, size):
        return [(i, '{"id":"%s","chargerEmail":"a@b"}' % i) for i, _ in super().page(number, size)]

    def detail(self, source_id):
        if source_id == "bad":
            raise ValueError("no such page")
        return '{"id":"%s","body":{"contactTelno":"1","text":"x"}}' % source_id if int(source_id) % 2 == 0 else None


def test_detail_lookup(spark):
    budget = CallBudget(2)
    d = fetch_detail(Postings(9), "4", budget)
    assert d == RawDocument("made", "4", "detail", {"id": "4", "body": {"text": "x"}}) and len(d.content_hash) == 64
    assert fetch_detail(Postings(9), "3", budget) is None and budget.used("made") == 2
    with pytest.raises(BudgetExceeded):
        fetch_detail(Postings(9), "4", budget)
    PagedSource.register(spark, "made", lambda options: Postings(250))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("made").option("lookups", "true").load().where("source_id = '4'")
        assert [r.source_id for r in one.collect()] == ["4"] and one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_query_options():
    q = ListQuery.of({"pageSize": "50", "categories": "a, b", "publishedFrom": "2026-01-02"})
    assert (q.page_size, q.job_categories, q.published_from.day, q.regions) == (50, ("a", "b"), 2, ())


def test_ingestion_runs(spark, tmp_path):
    runs, path = RunTable(spark, f"file://{tmp_path}/runs"), f"file://{tmp_path}/raw"
    assert runs.latest().count() == 0
    first = run_ingestion(spark, Postings(50), ListQuery(page_size=20), runs, path, batch_size=80)
    assert (first.fetched, first.inserted, first.duplicates, first.api_calls) == (75, 75, 0, 53)
    stored = raw_rows(spark, path)
    assert stored.count() == 75 and stored.where("payload LIKE '%chargerEmail%' OR payload LIKE '%contactTelno%'").count() == 0
    assert {r.flush for r in stored.select("flush").distinct().collect()} == {0, 1}
    again = run_ingestion(spark, Postings(50), ListQuery(page_size=20), runs, path, batch_size=80)
    assert (again.fetched, again.inserted, again.duplicates) == (75, 0, 75) and raw_rows(spark, path).count() == 75
    with pytest.raises(BudgetExceeded):
        run_ingestion(spark, Postings(90), ListQuery(page_size=20), runs, path, budget=CallBudget(50), batch_size=40)
    assert raw_rows(spark, path).count() == 75  # the flushes before the end stay, and bring nothing new
    with pytest.raises(ZeroDivisionError), runs.run("made") as handle:
        handle.fetched = 1 // 0
    states = {r.id: r for r in runs.rows().collect()}
    assert [states[i].status for i in (1, 2, 3, 4)] == ["success", "success", "budget", "failed"]
    assert states[3].fetched_count == 60 and '"limit": 50' in states[3].error_detail and states[4].error_count == 1
    assert all(s.finished_at is not None for s in states.values()) and runs.latest("made").first().id == 4


def test_vocabulary(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "vocabulary.yaml"
    path.write_text("roles:\n  - {name: 백엔드, weight: 3}\n  - 모바일\nnote: none\n")
    lists = load_vocabulary(spark, str(path))
    assert {k: [(r.value, r.weight) for r in v.collect()] for k, v in lists.items()} == {"roles": [("백엔드", 3.0), ("모바일", 1.0)]}


def test_spellings_and_truth(spark):
    s = spark.createDataFrame([("Python",), ("Git",)], "s string")
    assert [tuple(r) for r in s.select(synthetic.surface(F.col("s"), F.lit(0.1)), synthetic.surface(F.col("s"), F.lit(0.5)), synthetic.canonical(synthetic.surface(F.col("s"), F.lit(0.1)))).collect()] == [("파이썬", "Python", "Python"), ("Git", "Git", "Git")]
    truth = synthetic.ground_truth(spark, 50, source_id="SAMPLE-000007").collect()
    assert len(truth) == 1 and set(truth[0].required) <= set(synthetic.SKILLS)


def test_batches_of_files(spark, tmp_path):
    spark.range(6).repartition(6).write.parquet(f"file://{tmp_path}/in")
    sizes = []
    ingest.run_available(ingest.stream(spark, f"file://{tmp_path}/in", "id long", max_files=2), f"file://{tmp_path}/c", lambda b, i: sizes.append(b.count()))
    assert len(sizes) >= 3 and sum(sizes) == 6


def test_tumbling_counts(spark, tmp_path):
    spark.createDataFrame([("s", datetime(2026, 1, 1, h)) for h in (1, 5)] + [("s", datetime(2026, 1, 9))], "source string, ts timestamp").write.parquet(f"file://{tmp_path}/in")
    got = []
    counts = ingest.tumbling_counts(ingest.stream(spark, f"file://{tmp_path}/in", "source string, ts timestamp"), "source", "ts")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda b, i: got.append({(r.source, r.window.start.day): r.asked for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got[-1] == {("s", 1): 2, ("s", 9): 1}
