"""All registered queries, and the pipeline, over whole tables that are empty or messy."""

import random

import pytest
from conftest import MESSY
from pyspark.sql import functions as F

from lodewell.llm import registry, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string"
COUNTED = ["op1_document_fingerprints", "op3_source_mixing", "op4_token_store", "op5_toxicity", "op6_substring_dedup", "op7_lm_scoring", "op8_minhash_near_dedup", "op9_byte_level_bpe", "op10_language_id"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """(messy, empty): paths with the three tables that the queries read; labels of messy are null or repeated."""
    out = []
    for kind in ("messy", "empty"):
        root = tmp_path_factory.mktemp(kind)
        docs = spark.createDataFrame([(*r, len(r[1] or ""), i, "x") for i, r in enumerate(MESSY)], DOCS)
        labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (7, None, None), (7, 1, 1), (7, 1, 1), (None, None, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
        vectors = spark.createDataFrame([(100, [0.5, 1.0], 1), (1, None, 1), (2, [float("nan"), 0.0], None), (3, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (None, [0.1, 0.2], 0), (4, [None, 1.0], 1), (200, [], 3)], "vec_id long, embedding array<float>, label int")
        for name, df in (("documents", docs), ("labels", labels), ("embeddings", vectors)):
            (df if kind == "messy" else df.limit(0)).write.parquet(f"file://{root}/{name}.parquet")
        out.append(f"file://{root}")
    return out


@pytest.mark.parametrize("name", COUNTED)
def test_a_row_for_each_document(spark, folders, name):
    messy, empty = folders
    got = registry.QUERIES[name](spark, messy).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in MESSY)
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_top_k_of_messy_vectors(spark, folders):
    got = {(r.query_id, r["rank"]): r.vec_id for r in registry.QUERIES["op2_exact_top_k"](spark, folders[0]).collect()}
    assert got[100, 1] == got[100, 2] == 3 and registry.QUERIES["op2_exact_top_k"](spark, folders[1]).count() == 0


def test_pipeline_of_messy_and_empty_tables(spark, folders):
    import corpus_pipeline

    messy, empty = folders
    assert corpus_pipeline.run(spark, empty).count() == 0
    got = corpus_pipeline.run(spark, messy)
    assert got.columns[0] == "doc_id" and {r.doc_id for r in got.collect()} <= {r[0] for r in MESSY}
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, messy).columns == docs.columns, name


def test_the_language_stage_acts_on_predictions(spark):
    import corpus_pipeline

    rng = random.Random(1)
    words = {"en": "the of and house water people through which their other".split(), "de": "der und die haus wasser menschen durch welche ihre andere".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=40)), k) for i, k in enumerate(["en", "de"] * 60)]
    odd = [(1_000, " ".join(words["de"] * 4), "en"), (1_001, " ".join(words["de"] * 4), None), (1_002, "123 ...", None), (1_003, None, "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    gone = {r.doc_id for r in docs.join(corpus_pipeline.identify_language(spark, docs, ""), "doc_id", "left_anti").collect()}
    assert gone == {1_000, 1_002, 1_003}


def test_toxicity_separates_held_out_texts(spark):
    """Insults among random words, with misspellings in the held-out rows; short texts of unseen words stay clean."""
    rng = random.Random(8)
    plain = [a + b + c for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ko", "vel") for c in ("", "dir", "mo", "sten")]
    insults = ["grobbler", "snarfwit", "bungleton", "mudwadder"]

    def text(toxic: bool, odd: bool) -> str:
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        if toxic:
            bad = rng.choice(insults)
            w.insert(rng.randrange(len(w)), bad[:3] + bad[4] + bad[3] + bad[5:] if odd else bad)
        return " ".join(w)

    rows = [(i, text(i % 4 == 0, False), int(i % 4 == 0)) for i in range(800)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    held = spark.createDataFrame([(i, text(i % 2 == 0, i % 4 == 0)) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r.toxic_score for r in toxicity.score(held, model).collect()}
    known, misspelled, clean = ([got[i] for i in ids] for ids in (range(2, 300, 4), range(0, 300, 4), range(1, 300, 2)))
    assert sum(p >= 0.5 for p in known) / len(known) >= 0.95 and sum(p < 0.5 for p in clean) / len(clean) >= 0.95
    assert sum(m > c for m in misspelled for c in clean) / len(misspelled) / len(clean) >= 0.75
    unseen = spark.createDataFrame([(i, "".join(rng.choices("qxzwy", k=9))) for i in range(50)], "doc_id long, text string")
    assert toxicity.score(unseen, model).where("toxic_score >= 0.5").count() == 0 and toxicity.score(unseen, model).agg(F.min("toxic_score")).first()[0] >= 0
