"""The registered queries over the smallest tables, against SQL or brute force."""

import json
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zlib
from brute import crc, lm, near, removed, sha

from lodewell.llm import registry
from lodewell.llm.bpe import read_ranks


def named(result, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in result.collect()}


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_mix_comes_near_its_targets(spark, sf, documents):
    got = registry.QUERIES["op3_source_mixing"](spark, sf)
    source = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in got.collect():
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    assert sum(abs(taken[s] - target[s]) for s in taken) < 0.15 * sum(target.values())


def test_token_store(spark, sf, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = named(registry.QUERIES["op4_token_store"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32"), 0
    for r in rows:
        ids = [*tk.encode(r.text, add_special_tokens=False).ids, 0]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_toxicity_learns(spark, sf):
    got = registry.QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(got) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0) for r in got)


def test_substring_dedup(spark, sf, rows):
    got = named(registry.QUERIES["op6_substring_dedup"](spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256")
    for r, (w, kept) in zip(rows, removed([r.text for r in rows], 35), strict=True):
        assert got[r.doc_id] == (len(w), len(w) - len(kept), sha(" ".join(kept)))


def test_lm(spark, sf, rows):
    got = {r.doc_id: r for r in registry.QUERIES["op7_lm_scoring"](spark, sf).collect()}
    want, n = lm([r.text for r in rows if crc(r.doc_id, 5) != 1], [r.text for r in rows])
    for r, (tokens, known, base, score) in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (crc(r.doc_id, 5) == 1, tokens, known, n)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(score, abs=0.05 * tokens)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_near_dedup(spark, sf, rows):
    got = named(registry.QUERIES["op8_minhash_near_dedup"](spark, sf), "doc_id", "n_shingles", "component_id", "kept")
    sizes, ids, _ = near([r.doc_id for r in rows], [r.text for r in rows], 2)
    assert all(got[r.doc_id] == (n, c, c == r.doc_id) for r, n, c in zip(rows, sizes, ids, strict=True))


def test_bpe(spark, sf, rows):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = named(registry.QUERIES["op9_byte_level_bpe"](spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r.text))


def test_language_id(spark, sf, rows):
    got = named(registry.QUERIES["op10_language_id"](spark, sf), "doc_id", "held_out", "lang_pred", "score")
    assert all(got[r.doc_id][0] == (crc(r.doc_id, 3) == 1) and 0 <= got[r.doc_id][2] <= 1 for r in rows)
    held = [got[r.doc_id][1] == r.lang for r in rows if crc(r.doc_id, 3) == 1]
    assert sum(held) / len(held) > 0.93


def test_pipeline(spark, sf, rows, duck):
    """Each stage by brute force: predictions against lang, five-word near-duplicates, repeated passages, the mix by SQL, tiktoken."""
    import corpus_pipeline
    from lodewell.llm import langid

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    predicted = {r.doc_id: r.lang_pred for r in langid.identify(documents, langid.fit(documents)).collect()}
    docs = [r for r in rows if predicted[r.doc_id] == r.lang]
    assert len(docs) > 0.95 * len(rows)
    _, _, groups = near([r.doc_id for r in docs], [r.text for r in docs], 5)
    first = {}
    for r, g in zip(docs, groups, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    docs = [r for r in docs if r.doc_id in set(first.values())]
    cut = []
    for r, (w, kept) in zip(docs, removed([r.text for r in docs], 35), strict=True):
        if len(kept) == len(w) or kept:
            cut.append((r.doc_id, r.text if len(kept) == len(w) else " ".join(kept), r.source))
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(cut, columns=["doc_id", "text", "source"]))
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    copies = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({registry.ORACLES['op3_source_mixing']}) WHERE size > 0").fetchall()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, text, _ in cut:
        ids = enc.encode_ordinary(text)
        want += [(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))] * copies[i]
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "bpe"]
    json.dumps(corpus_pipeline.ORACLE_SQL)
