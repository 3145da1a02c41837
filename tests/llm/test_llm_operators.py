"""Messy and empty tables, and the kernels' own properties."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import lm, near, removed, sha, words
from conftest import MESSY
from pyspark.sql import functions as F

from lodewell.llm import bpe, components, eliasfano, fingerprint, langid, mixing, neardup, ngram_lm, pretokenize, repeats, substring, tokenstore, topk, toxicity
from lodewell.llm.common import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
IDS, TEXTS = [r[0] for r in MESSY], [r[1] for r in MESSY]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def by_id(rows):
    return sorted(rows, key=repr)


# Fingerprints


def test_fingerprints_of_messy_rows(messy, empty):
    got = fingerprint.edited_against_next(messy).collect()
    order = sorted(((i, t or "") for i, t in zip(IDS, TEXTS, strict=True)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        want.append((i, n, sha(t[: n - n // 2] + nxt[: n // 2])))
    assert by_id((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == by_id(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.edited_against_next(empty).count() == 0


def test_roots_and_differing_branches(spark):
    a, b = "one. two.\nthree.\n\nfour. five.", "one. two.\nthree!\n\nfour. five."
    df = spark.createDataFrame([(a, b), (a, a), (a, "one. two.\n\nthree.\n\nfour. five."), ("", None)], "text string, b string")
    got = fingerprint.fingerprints(df).withColumn("o", fingerprint.pieces(F.col("b"))).select((F.col("fingerprint") == fingerprint.root(F.col("o"))).alias("same"), fingerprint.differing(F.col("tree"), F.col("o")).alias("d")).collect()
    assert [r.same for r in got] == [False, True, False, True]
    assert [(x.section, x.paragraph) for x in got[0].d] == [(0, 1)] and got[1].d == []


def test_buckets_close_their_ends(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 4)
    for quantiles, ids in ((3, [5 * i for i in range(60)]), (3, [-(1 << 63) + 9, (1 << 63) - 9, *range(50)]), (4096, [5 * i for i in range(60)]), (4096, [1] * 9 + [10**15, 10**15 + 1, 3] + list(range(100, 130)))):
        monkeypatch.setattr(fingerprint, "QUANTILES", quantiles)
        df = spark.createDataFrame([(i, f"t{k:03d}") for k, i in enumerate(ids)], "doc_id long, text string")
        got = {r.text: r.following for r in fingerprint.with_next(df).collect()}
        order = [t for _, t in sorted(((i, f"t{k:03d}") for k, i in enumerate(ids)), key=lambda r: (-r[0], r[1]))]
        assert got == dict(zip(order, order[1:] + order[:1], strict=True))


# Top-k


def exact(vectors, queries, k):
    out = []
    for q, x in queries:
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(150, 260)]  # one vector many times
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0, 2.0]), (305, [3.0, 4.0]), (306, [])]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = [(r.vec_id, r.v) for r in df.collect()]
    assert {i for i, _ in held} == {i for i, _ in rows} - {300, 301, 302, 303}
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id > 300"), 5).collect())
    assert got == exact(held, [(i, v) for i, v in held if i % 20 == 0 or i > 300], 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_products_are_exact():
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**15, 5.0], [1.0, 1.0]])
    assert topk.products(q, v).tolist() == [[2**55 + 15, 2**40 + 3]]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, pivots = rng.normal(size=(400, 6)), rng.normal(size=(5, 6))
    d = topk.distances(x, pivots)
    near_, far = d.argmin(1), d.min(1)
    for p in range(5):
        m = near_ == p
        r = topk.Rings(pivots, np.array([p * topk.RINGS]), np.array([far[m].min()]), np.array([far[m].max()]), np.array([np.linalg.norm(x[m], axis=1).max()]), np.array([m.sum()]))
        assert ((x @ x[m].T).max(1) <= r.bounds(x)[:, 0]).all()


def test_bounds_stop_the_search(monkeypatch):
    """Of vectors in tight clusters, a query reads its own cluster's groups and few others."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 10
    x = np.repeat(centres, 50, 0) + rng.normal(size=(1_000, 8)) * 0.1
    pivots = topk.fit_pivots(x, len(x))
    d = topk.distances(x, pivots)
    ring = d.argmin(1) * topk.RINGS
    kinds = np.unique(ring)
    by = lambda f, v: np.array([f(v[ring == k]) for k in kinds])
    r = topk.Rings(pivots, kinds, by(np.min, d.min(1)), by(np.max, d.min(1)), by(np.max, np.linalg.norm(x, axis=1)), by(len, x))
    kth = np.sort(x[:40] @ x.T, 1)[:, -10]
    early, late = (len(r.reads(x[:40], t, 10)[0]) / 40 / len(r.first) for t in (None, kth))
    assert early + late < 0.4


# Mixing


def test_mix_of_messy_rows(messy, empty):
    sized = messy.select("doc_id", "source", mixing.size_of().alias("__lw_size"))
    rates = {r.source: r for r in mixing.rates(sized).collect()}
    total = sum(r.source_size for r in rates.values())
    assert sum(r.target for r in rates.values()) <= 1.5 * total + 1e-6 and all(r.target <= 2 * r.source_size for r in rates.values())
    out = mixing.mix(messy)
    assert out.columns == messy.columns
    counts = {}
    for r in out.collect():
        counts[r.size] = counts.get(r.size, 0) + 1
    assert all(n <= 2 for n in counts.values())
    assert by_id(map(tuple, mixing.mix(messy).collect())) == by_id(map(tuple, out.collect()))
    assert mixing.mix(empty).count() == 0


def test_large_source_tables_are_salted(messy, monkeypatch):
    whole = by_id(map(tuple, mixing.mix(messy).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert by_id(map(tuple, mixing.mix(messy).collect())) == whole


# Token store


def test_store_of_messy_rows(spark, messy, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    out = shared_dir(spark)
    manifest = tokenstore.write_store(messy, out, path, 0)
    got = sorted(tokenstore.read_store(spark, out, manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == [False] * 2 + [True] * (len(MESSY) - 2)
    assert [r.doc_id for r in got[2:]] == sorted(i for i in IDS if i is not None)
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 0
        at += len(ids)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted([*tk.encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS)
    base = tokenstore.open_fs(out)
    dictionary = base[0].open_input_stream(f"{base[1]}/dictionary").read()
    found = [x.tolist() for r in manifest for x in tokenstore.Shard(out, r["path"], dictionary).find(13)]
    assert found == [[*tk.encode(MESSY[-1][1], add_special_tokens=False).ids, 0]]
    with pytest.raises(ValueError, match="not a token shard"):
        tokenstore.Shard(out, manifest[0]["path"], dictionary + b"x")
    none = shared_dir(spark)
    assert tokenstore.read_store(spark, none, tokenstore.write_store(empty, none, path)).count() == 0


def test_store_has_the_ids_of_added_tokens(spark):
    """Against the library's own encoding of texts that hold the added token, whole, in part, repeated and beside white space."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|", "it'<|endoftext|>s  <|endoftext|>  y", "  <|endoftext|>\n\n", "plain", "é<|endoftext|>😀 <|ENDOFTEXT|>", "<<|endoftext|>>", ""]
    out = shared_dir(spark)
    manifest = tokenstore.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out, path, 0)
    got = sorted(tokenstore.read_store(spark, out, manifest, with_ids=True).collect(), key=lambda r: r.doc_id)
    want = [[*tk.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert 50256 in want[0] and [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()


def test_store_looks_up_only_distinct_slices(monkeypatch):
    """Over several runs of texts, one of them longer than a run, with slices that differ in their bytes' widths."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    texts = ["né the  word\n" * 50_000, "", "other the 😀 " * 60_000, "  \n\n", "x's " * 600_000, "né the end"]
    looked_up, call = [], bpe.SliceEncoder.__call__
    monkeypatch.setattr(tokenstore, "SOME", 5, raising=False)
    monkeypatch.setattr(bpe.SliceEncoder, "__call__", lambda self, slices: looked_up.extend(slices) or call(self, slices))
    got = list(tokenstore.encoder(path).whole(texts))
    assert got == [np.array(tk.encode(t, add_special_tokens=False).ids, tokenstore.model(path)[2]).tobytes() for t in texts]
    assert len(looked_up) < 40


# Classifiers


def test_toxicity_shares_character_ngrams(spark, messy, empty):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ko", "vel", "dir", "mo")]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["grobble", "snarfing"]))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    assert (model.logits(["lona grobbel miko", "tavel snarffing lona"]) > model.logits(["lona rako miko", "tavel sumo lona"])).all()
    assert ((model.logits(texts) >= 0) == np.array(labels)).mean() > 0.95
    got = toxicity.score(messy, model).collect()
    assert by_id(r.doc_id for r in got) == by_id(IDS) and all(0 <= r.toxic_score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert (nothing.logits(["x", ""]) < 0).all()


def test_long_texts_do_not_end_the_toxicity_sample(spark, monkeypatch):
    """Long texts of either label, together over the room, wherever the hash order has them."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 6_000)
    rows = [(i, f"lona miko tavel {'grobble' if i % 3 == 0 else 'sumo'}", int(i % 3 == 0)) for i in range(60)]
    for longer in (0, 1):
        many = rows + [(100 + i, "rako " * 1_300, longer) for i in range(40)] + [(200 + i, "rako " * 700, longer) for i in range(40)]
        model = toxicity.fit(spark.createDataFrame(many, "doc_id long, text string, toxic int").repartition(2))
        high, low = model.logits(["miko grobble lona", "miko sumo lona"]).tolist()
        assert high > 0 > low
    units = sorted(((i, "x" * n, y) for i, (n, y) in enumerate([(9_000, 1), (10, 0), (20, 1), (5_000, 0), (2_000, 1), (30, 0)])), key=lambda r: len(r[1]))
    assert [(u, len(t)) for u, t, _ in toxicity.bounded(units)] == [(1, 10), (2, 20), (4, 2_000), (5, 30)]
    assert [(len(t), y) for _, t, y in toxicity.bounded([(0.1, "a" * 6_000, 0), (0.2, "b" * 6_000, 1)])] == [(3_000, 0), (3_000, 1)]


def test_language_of_messy_rows(messy, empty, documents):
    model = langid.fit(documents)
    assert {f for f, _ in model.families} == {"germanic", "romance"} and len(model.pairs["germanic"]) == 1
    got = langid.identify(messy, model)
    assert got.columns == [*messy.columns, "lang_pred", "lang_score"]
    for r in got.collect():
        letters = any(unicodedata.category(c)[0] == "L" for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, langid.fit(empty)).collect()} == {"und"}


# Substrings


@pytest.mark.parametrize("level", [2])
def test_packed_rows_in_two_steps(spark, messy, monkeypatch, level):
    """As if there were far more buckets than a task packs for: substring windows and n-gram counts are the same."""
    one = [(str(r["doc_id"]), r["__lw_removed"], r["__lw_kept"]) for r in substring.remove(messy, 5).collect()]
    rows = messy.select("doc_id", "text", F.lit(False).alias("held"))
    score = lambda: sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in ngram_lm.scored(rows, ngram_lm.train(messy)).collect())
    plain = score()
    monkeypatch.setattr(repeats, "LEVEL", level)
    assert repeats.width(4) == 2
    assert sorted(one) == sorted((str(r["doc_id"]), r["__lw_removed"], r["__lw_kept"]) for r in substring.remove(messy, 5).collect())
    assert plain == score()


@pytest.mark.parametrize("window", [3, 10, 35, 50])
def test_substrings_of_messy_rows(messy, empty, window):
    got = substring.remove(messy, window)
    assert got.columns == [*messy.columns, "__lw_words", "__lw_removed", "__lw_kept"]
    have = {r.size: (r["__lw_words"], r["__lw_removed"], r["__lw_kept"]) for r in got.collect()}
    want = {i: (len(w), len(w) - len(k), " ".join(k)) for i, (w, k) in enumerate(removed(TEXTS, window))}
    assert have == want
    if window == 35:
        assert substring.remove(empty, window).count() == 0


def test_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for window in range(1, 200):
        period, cover = substring.cover_for(window)
        assert window - period + 1 >= 1 and {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_word_hashes_match_words():
    texts = ["a b  a b\n", "", " x", "a b a b c", "\t"]
    h = substring.WordHashes(texts)
    assert np.diff(h.bounds).tolist() == [len(words(t)) for t in texts]
    w = h.windows(np.array([0, 2, 5, 7]), 2)
    assert (w[0] == w[1]).all() and (w[0] == w[2]).all() and (w[0] == w[3]).all()


def test_hot_keys_are_aggregated_before_the_shuffle(monkeypatch):
    run = repeats.Run(4)
    for doc in range(1_000):
        run.add(doc, doc, np.arange(3), np.array([[7], [8], [doc + 100]], np.uint64))
    batch = run.rows()
    asked = [repeats.unpack(b) for k, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if k == repeats.ASKED]
    assert sum(len(a[3]) for a in asked) == 1_002  # 7 and 8 once each


# Language model


def test_lm_of_messy_rows(spark, messy, empty):
    model = ngram_lm.train(messy)
    rows = messy.select("doc_id", "text", F.lit(False).alias("held"))
    got = ngram_lm.scored(rows, model).collect()
    assert by_id((r.doc_id, r.n_tokens, r.n_known) for r in got) == by_id((i, len(words(t)) + 1, len(words(t)) + 1) for i, t in zip(IDS, TEXTS, strict=True))
    assert model.vocabulary.tokens == sum(len(words(t)) + 1 for t in TEXTS)
    nothing = ngram_lm.train(empty)
    none = ngram_lm.scored(rows, nothing).where("doc_id = 12").first()
    assert nothing.vocabulary.tokens == 0 and none.n_known == 0 and none.score == none.base_score == 0.0


def test_lm_probabilities_add_up(spark):
    model = ngram_lm.train(spark.createDataFrame([("a b a c a b",), ("b a b",), ("a b",)], "text string"))
    hashes, _ = ngram_lm.tokens(["a b c"])
    ids, counts = model.vocabulary.find(np.unique(hashes))
    a = int(ids[np.searchsorted(np.unique(hashes), hashes[0])])
    level = model.level(2, int(ngram_lm.shard_of(np.array([a]), model.shards)[0]))
    seen = dict(level.successors(a))
    everything = np.arange(model.vocabulary.size)
    back, weights, _ = level.weights(np.array([a]), np.zeros(len(everything), int), everything)
    assert {i for i in everything.tolist() if weights[i] > 0} == set(seen)
    assert weights.sum() + back[0] == pytest.approx(1, abs=1e-9)


def test_lm_keeps_triples_seen_once(spark):
    """Against brute force without a least count; the last word of the passage follows several pairs, so only its triple tells."""
    train = ["one x y p", "two x z q", "three w y r", "four w z s", "a b c d e f g", "b c x", "b c x", "c d x"]
    texts = ["one x y p", "a b c d e f g", "four w z s", "nothing known here", ""]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    want, n = lm(train, texts)
    tokens, known, base, score = (x.tolist() for x in model.score(texts))
    assert model.vocabulary.tokens == n and list(zip(tokens, known, strict=True)) == [w[:2] for w in want]
    assert base == pytest.approx([w[2] for w in want], rel=1e-9) and score == pytest.approx([w[3] for w in want], abs=0.01)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 3], [1, 2, 3, 1000, 10**12], list(range(1000)), [63, 64, 127, 128, 1 << 62], [9] * 200 + [12] * 70 + [1 << 40]])
def test_elias_fano(values):
    s = eliasfano.Sequence(eliasfano.encode(np.array(values, np.uint64)))
    if values:
        assert s.access(np.arange(len(values))).tolist() == values
    ask = sorted({v + d for v in [*values, 7] for d in (-1, 0, 1) if v + d >= 0})
    at, equal = s.successor(np.array(ask, np.uint64))
    assert at.tolist() == [next((i for i, v in enumerate(values) if v >= x), len(values)) for x in ask] and equal.tolist() == [x in values for x in ask]


# Near-duplicates


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_messy_rows(messy, empty, size):
    got = neardup.near_duplicates(messy, size).collect()
    sizes, ids, groups = near(IDS, TEXTS, size)
    assert by_id((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_id(zip(IDS, sizes, [c if n else i for i, n, c in zip(IDS, sizes, ids, strict=True)], strict=True))
    if size == 5:
        kept = neardup.keep_one(messy, size)
        assert kept.columns == messy.columns
        blank = {(i, t or "") for i, t, n in zip(IDS, TEXTS, sizes, strict=True) if not n}
        assert kept.count() == len({g for g, n in zip(groups, sizes, strict=True) if n}) + len(blank)
        assert neardup.keep_one(empty).count() == 0


@pytest.mark.parametrize(("members", "shingles"), [(2_048, 1 << 21), (24, 1 << 21), (2_048, 1_500)])
def test_chains_around_the_threshold(spark, monkeypatch, members, shingles):
    """A large family of near copies whose links are not all with one centre; in one task, and cut by members or by shingles."""
    monkeypatch.setattr(neardup, "GROUP_MEMBERS", members)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{i}_{j}" for j in range(50))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, ids, _ = near([r[0] for r in rows], [r[1] for r in rows], 2)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()} == dict(zip([r[0] for r in rows], ids, strict=True))


def test_groups_hold_every_pair_of_a_bucket(spark, monkeypatch):
    """Clusters that are cut into pairs of chunks, and others that are cut into buckets (some of them cut again)."""
    monkeypatch.setattr(neardup, "GROUP_MEMBERS", 12)
    rng = random.Random(6)
    rows = [(b, f"n{i:03d}") for b in range(6) for i in rng.sample(range(40), 30)]  # buckets like the cluster
    rows += [(100 + b, f"c{b + i:03d}") for b in range(60) for i in range(4)]  # a long chain of small buckets
    rows += [(200 + b, f"c{i:03d}") for b in range(2) for i in range(14)]  # twice the same members
    members = spark.createDataFrame([(x, x[0], 10) for x in sorted({r[1] for r in rows})], "node string, cluster string, n long")
    got, parts = set(), {}
    for r in neardup.groups(spark.createDataFrame(rows, "bucket long, node string"), members).collect():
        parts.setdefault(r.part, set()).add(r.node)
    for part in parts.values():
        got |= {(a, b) for a in part for b in part}
    buckets = {}
    for bucket, name in rows:
        buckets.setdefault(bucket, set()).add(name)
    assert all((a, b) in got for names in buckets.values() for a in names for b in names if a != b)
    assert sum(1 for p in parts if p.startswith("c/")) == 0 and any(p.startswith("n/") for p in parts)
    assert not {p.split("/")[0] for p in parts} >= {"200", "201"}


def test_intersections_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300), dtype=np.uint64)) for _ in range(60)]
    got = neardup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j)


def test_bins_estimate_similarity():
    s, rng = neardup.Sketcher(), np.random.default_rng(5)
    for n in (5, 40, 400, 4_000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = x.copy()
        y[: max(1, n // 10)] = rng.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert (s.bins(np.sort(x)) == s.bins(np.sort(y))).mean() == pytest.approx(true, abs=0.1)


def test_bins_agree_across_short_and_long_sets():
    """Sets of 40 to 60 shingles, on both sides of the switch to the short path; filled bins keep their own value on either."""
    s, rng = neardup.Sketcher(), np.random.default_rng(9)
    estimates, missed, sides = [], 0, set()
    for small, large in [(40, 50), (44, 55), (46, 53), (48, 60)] * 40:
        y = rng.integers(0, 1 << 63, large, dtype=np.uint64)
        x = y[:small]
        a, b = s.bins(x), s.bins(y)
        for shingles, bins in ((x, a), (y, b)):
            h = np.sort(neardup.mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)))
            at, first = np.unique((h >> np.uint64(55)).astype(np.int64), return_index=True)
            sides.add(len(at) <= 48)
            assert (bins[at] == h[first]).all()
        estimates.append((a == b).mean() - small / large)
        missed += not (a == b).reshape(neardup.BANDS, neardup.ROWS).all(1).any()
    assert sides == {True, False} and abs(np.mean(estimates)) < 0.02 and not missed


@pytest.mark.parametrize("run", [1 << 20, 9, 30])
def test_components(spark, monkeypatch, run):
    """In one run, by rounds of labels, and by contraction in several steps."""
    monkeypatch.setattr(components, "RUN_EDGES", run)
    edges = [("a", "b"), ("b", "c"), ("d", "e"), *[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[x] for x in "abc"} == {"a"} and got["e"] == "d" and {got[f"n{i:02d}"] for i in range(41)} == {"n00"}


# Byte-level BPE


def test_bpe_of_messy_rows(messy, empty, reference):
    got = bpe.encode(messy, RANKS, decode_too=True, slices=True).collect()
    want = {t or "": reference.encode_ordinary(t or "") for t in TEXTS}
    assert by_id((r.doc_id, bytes(r.decoded).decode()) for r in got) == by_id((i, t or "") for i, t in zip(IDS, TEXTS, strict=True))
    for r in got:
        text, ids = bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[text]
        at, counts = np.frombuffer(r.slice_offsets, "<u4").tolist(), np.frombuffer(r.slice_counts, "<u4").tolist()
        assert sum(counts) == len(ids) and "".join(text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=False)) == text
    assert by_id(r.text for r in bpe.decode(bpe.encode(messy, RANKS), RANKS).collect()) == by_id(t or "" for t in TEXTS)
    assert bpe.digests(empty, RANKS).count() == 0


def test_slices_match_the_pattern(reference):
    rng = random.Random(6)
    letters = [*"aZ1٣ '\n\t.,-éß漢 　\U0001f600", "'s", "'re", "'ll", "'t", " 's", "''", "  ", "\r\n", "́", "²", "ll", "\x1c", "\x85"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1_500)] + ["a" * 900, "'" * 700, " " * 600, "ab " * 400, ""]
    encoder = bpe.SliceEncoder(lambda w: bpe.merge(w.encode(), ranks))
    ranks = bpe.read_ranks(RANKS)
    assert [np.frombuffer(x, "<u4").tolist() for x, _, _ in encoder.all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_codepoint_classes():
    """Against tiktoken's own: by ranks that merge a letter, a digit or a mark with a following byte, which shows whether they share a slice."""
    ranks = {bytes([i]): i for i in range(256)}
    for kind in b"a1!":
        for byte in range(256):
            ranks[bytes([kind, byte])] = len(ranks)
    encoding = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = pretokenize.classes()
    joins = lambda kind, c: len(encoding.encode_ordinary(kind + c)) == len(c.encode())
    for cp in [*range(0x3400), *range(0xA000, 0xD800, 7), *range(0xE000, 0x1F000), *range(0x1F000, 0x110000, 97), *(a for r in pretokenize.NEW_LETTERS + pretokenize.NEW_NUMBERS for a in r)]:
        if cp != ord("'") and not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            want = next((k for kind, k in (("a", pretokenize.L), ("1", pretokenize.N), ("!", pretokenize.O)) if joins(kind, c)), pretokenize.WHITE)
            assert table[cp] == want, hex(cp)


def test_long_texts_go_by_pieces(monkeypatch, reference):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    ranks = bpe.read_ranks(RANKS)
    encoder = bpe.SliceEncoder(lambda w: bpe.merge(w.encode(), ranks))
    for text in ("it's  a long one, isn't it? 123 " * 30, "x" * 700, " " * 400):
        ((ids, at, counts),) = encoder.all([text], True)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and at[0] == 0 and (np.diff(at) > 0).all()


def test_long_merges():
    ranks = bpe.read_ranks(RANKS)
    rng = random.Random(7)
    for _ in range(30):
        piece = bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 120)))
        assert bpe.merge_long(piece, ranks) == bpe.merge(piece, ranks) or piece in ranks
