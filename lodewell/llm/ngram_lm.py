"""Language-model scoring by an Elias-Fano n-gram trie (operator 7).

Training counts words, then pairs and triples, in packed pre-aggregated runs; every count covers all training
texts. A word's id is its rank by 64-bit hash. The trie's nodes are contexts; a shard of a level holds, for the
contexts that hash to it, in Elias-Fano sequences: the contexts, monotone pointers to their successors, and the
successors' ids relative to their context (context index * vocabulary + id, so the level is monotone too). Eight
bits quantise each successor's discounted probability and each context's back-off weight. Files are
memory-mapped by the scoring tasks, which look up whole batches of positions by successor search.

    P(w | context) = a(w | context) + b(context) * P(w | shorter context),  a = (count - D) / count(context)

for every successor that was seen, b = 1 - the sum of a over them, and the empty context has
(c + 1/2) / (N + (V + 1) / 2), which leaves an unknown word its share: probabilities add up to 1 but for the quantising.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import binary, chunks, crc_mod, mix64, open_fs, release, shared_dir, table
from lodewell.llm.eliasfano import Sequence, encode, read_arrays, write_arrays
from lodewell.llm.repeats import Format, dealt, pack, unpack, width
from lodewell.llm.words import WordHashes

ORDERS = (2, 3)
DISCOUNT = 0.75
#: The end of a text is a token; this is its place among the hashes.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
RUN_TOKENS, SHARD_TOKENS, SCORE_CHARS = 1 << 20, 1 << 21, 1 << 21
#: Files of a model that a worker keeps open at once: few bytes each where they are memory-mapped, whole files where they are not.
OPEN_FILES = 256
#: Distinct words at most: ids stay under 2 ** 32, and a context of two words under 2 ** 63.
MOST_WORDS = 3_000_000_000


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end; the tokens of each text."""
    words = WordHashes(texts, lower=True, hashes=1, windows=False)
    n = np.diff(words.bounds) + 1
    ends = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    if words.words:
        out[~is_end] = words.words[0]
    return out, n


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (columns, the first most significant), sorted, with their counts' sums."""
    order = np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    for i in range(1, len(keys)):  # each next key under 2 ** 32, within equal ones before it
        rank = np.cumsum(np.concatenate([[False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys[:i]])])) if len(order) else order
        again = np.argsort((rank << 32) | keys[i].astype(np.int64), kind="stable")
        order, keys = order[again], [k[again] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def stretches(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    edges = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return zip(x[edges].tolist(), edges, [*edges[1:], len(x)][: len(edges)], strict=True)


def narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers in 16 bits, which numpy sorts by radix."""
    return x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


class Opened:
    """The arrays of files by name; beyond OPEN_FILES, the one that was used longest ago is closed."""

    def __init__(self, path: str):
        self.path, self.held = path, OrderedDict()

    def get(self, name: str, make: Callable[[dict[str, np.ndarray]], object]) -> object:
        if name not in self.held:
            fs, base = open_fs(self.path)
            self.held[name] = make(read_arrays(fs, f"{base}/{name}"))
            if len(self.held) > OPEN_FILES:
                self.held.popitem(last=False)
        self.held.move_to_end(name)
        return self.held[name]


@dataclass
class Vocabulary:
    """Ids and counts of words: bucket i of the hash space starts at id bases[i] of its own file."""

    path: str
    bits: int
    bases: list[int]
    tokens: int
    size: int

    def find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, or -1 for an unknown word; count) of each of some sorted distinct hashes."""
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        bucket = (distinct >> np.uint64(64 - self.bits)).astype(np.int64)
        for i, a, b in stretches(bucket):
            got = self.file(i)
            if got is None:
                continue
            at = np.searchsorted(got["hashes"], distinct[a:b])
            hit = got["hashes"][np.minimum(at, len(got["hashes"]) - 1)] == distinct[a:b]
            ids[a:b] = np.where(hit, at + self.bases[i], -1)
            counts[a:b] = np.where(hit, got["counts"][np.minimum(at, len(got["counts"]) - 1)], 0)
        return ids, counts

    def file(self, i: int) -> dict[str, np.ndarray] | None:
        if self.bases[i + 1] == self.bases[i]:
            return None
        if not hasattr(self, "opened"):
            self.opened = Opened(self.path)
        return self.opened.get(f"words-{i:06d}", lambda arrays: arrays)


def put(out: str, name: str, arrays: dict[str, np.ndarray]) -> int:
    """Write a file under another name, then move it: a task that runs again replaces its own."""
    fs, base = open_fs(out)
    fs.create_dir(base, recursive=True)
    part = f"{base}/{name}.{uuid.uuid4().hex}.part"
    size = write_arrays(fs, part, arrays)
    fs.move(part, f"{base}/{name}")
    return size


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for batch in batches:
        for i, order, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield i, order, unpack(blob)


SENT = "bucket int, kind int, packed binary"


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), binary([r[2] for r in rows])], names=["bucket", "kind", "packed"])


def closed(kind: int, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns for packing: differences of the first, the others in few bits."""
    first, *rest = columns
    return [deltas(first), *[r.astype(np.int32) if r.max(initial=0) < 1 << 31 else r for r in rest]]


def opened(kind: int, arrays: list[np.ndarray]) -> list[np.ndarray]:
    first, *rest = arrays
    return [np.cumsum(first, dtype=first.dtype), *[r.astype(np.int64) for r in rest]]


def cut(shard: np.ndarray, columns: list[np.ndarray], ngram: int) -> list[tuple[int, int, bytes]]:
    """Sorted columns (the last: counts) by shard, packed."""
    order = np.argsort(narrow(shard), kind="stable")
    out = []
    for i, a, b in stretches(shard[order]):
        out.append((i, ngram, pack(closed(ngram, [c[order[a:b]] for c in columns]))))
    return out


def count_words(texts: DataFrame, out: str, buckets_log2: int) -> Vocabulary:
    """Count all tokens of `texts` (one column) and write the vocabulary's files."""
    buckets = 1 << buckets_log2
    step = width(buckets)

    def bucket(kind: int, columns: list[np.ndarray]) -> np.ndarray:
        return (columns[0] >> np.uint64(64 - buckets_log2)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size = [], 0

        def flush() -> pa.RecordBatch:
            (h,), n = summed([np.concatenate(run)], np.ones(size, np.int64))
            return sent(cut(bucket(1, [h]) // step, [h, n], 1))

        for batch in batches:
            for _, part in chunks(batch.column(0).cast(pa.binary()).to_pylist()):
                h, _ = tokens(part)
                run.append(h)
                size += len(h)
                if size >= RUN_TOKENS:
                    yield flush()
                    run, size = [], 0
        if size:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for i, _, arrays in blobs(batches):
            held.setdefault(i, []).append(opened(1, arrays))
        for i, parts in held.items():
            (h,), n = summed([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]).astype(np.int64))
            put(out, f"words-{i:06d}", {"hashes": h, "counts": n.astype(np.uint32 if n.max() < 1 << 32 else np.uint64)})
            yield pa.RecordBatch.from_pylist([{"shard": i, "size": len(h), "tokens": int(n.sum())}])

    made = dealt(texts.mapInArrow(count, SENT), buckets, Format(opened, closed, bucket)).mapInArrow(write, "shard long, size long, tokens long").collect()
    sizes = np.zeros(1 << buckets_log2, np.int64)
    for r in made:
        sizes[r["shard"]] = r["size"]
    if sizes.sum() > MOST_WORDS:
        raise ValueError(f"{sizes.sum()} distinct words; the model's ids hold {MOST_WORDS}")
    return Vocabulary(out, buckets_log2, [0, *np.cumsum(sizes).tolist()], sum(r["tokens"] for r in made), int(sizes.sum()))


@dataclass
class Run:
    """The tokens of some texts, as numbers of the run's distinct hashes (`kind`), which are in the order of the hashes and thus of ids."""

    hashes: np.ndarray
    kind: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, lengths: np.ndarray) -> Run:
        distinct, kind = np.unique(hashes, return_inverse=True)
        return cls(distinct, kind, np.arange(len(kind)) - np.repeat(np.cumsum(lengths) - lengths, lengths))

    def ngrams(self, order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(columns of kinds, counts) of the distinct n-grams within texts, sorted."""
        at, n = np.flatnonzero(self.place >= order - 1), len(self.hashes)
        columns = [self.kind[at - k] for k in range(order - 1, -1, -1)]
        if n**order >= 1 << 63:
            return summed(columns, np.ones(len(at), np.int64))
        key = columns[0]
        for c in columns[1:]:
            key = key * n + c
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count, key, out = np.diff(np.append(first, len(key))), key[first], []
        for _ in range(order - 1):
            key, last = np.divmod(key, n)
            out.append(last)
        return [key, *out[::-1]], count


def context_of(words: list[np.ndarray], size: int) -> np.ndarray:
    """The key of a context, of one word's ids or two words'."""
    return words[0] if len(words) == 1 else words[0] * size + words[1]


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    return ((mix64(context.astype(np.uint64)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook) of positive values: 256 levels at quantiles of the distinct values' logarithms."""
    distinct = np.log10(np.maximum(np.unique(values), 1e-30))
    book = np.unique(np.quantile(distinct, np.linspace(0, 1, 256))) if len(distinct) > 256 else np.unique(distinct)
    code = np.searchsorted(10 ** ((book[1:] + book[:-1]) / 2), values)
    return code.astype(np.uint8), book.astype(np.float64)


def level(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """A shard's level, of n-grams sorted by context and word; all of them are kept."""
    first = np.flatnonzero(np.diff(contexts, prepend=-1))
    total = np.add.reduceat(counts, first)
    seen = np.diff(np.append(first, len(contexts)))
    owner = np.repeat(np.arange(len(first)), seen)
    a = (counts - DISCOUNT) / total[owner]
    codes, book = quantised(a)
    back, back_book = quantised(np.maximum(1 - np.bincount(owner, a, len(first)), 1e-12))
    parts = {"contexts": encode(contexts[first]), "pointers": encode(np.concatenate([[0], np.cumsum(seen)])), "words": encode(owner.astype(np.uint64) * np.uint64(size) + words.astype(np.uint64))}
    flat = {f"{k}.{name}": x for k, v in parts.items() for name, x in v.items()}
    return flat | {"codes": codes, "book": book, "back": back, "back_book": back_book}


class Level:
    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        part = lambda k: Sequence({n: arrays[f"{k}.{n}"] for n in ("meta", "low", "unary", "zeros")})
        self.contexts, self.pointers, self.words = part("contexts"), part("pointers"), part("words")
        self.a, self.b = (10.0 ** arrays[book] for book in ("book", "back_book"))
        self.codes, self.back, self.size = arrays["codes"], arrays["back"], size

    def weights(self, contexts: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(b, a, more): b of each distinct context, 1 if unknown; for each word (an id, or -1) that follows contexts[owner], a (0 if unseen) and whether both together were seen, so that they may be a context of the next level."""
        b, a, more = np.ones(len(contexts)), np.zeros(len(word)), np.zeros(len(word), bool)
        node, known = self.contexts.successor(contexts)
        b[known] = self.b[self.back[node[known]]]
        ask = np.flatnonzero(known[owner] & (word >= 0))
        if len(ask):
            place, found = self.words.successor(node[owner[ask]].astype(np.uint64) * np.uint64(self.size) + word[ask].astype(np.uint64))
            hit = ask[found]
            a[hit] = self.a[self.codes[place[found]]]
            more[hit] = True
        return b, a, more

    def successors(self, context: int) -> list[tuple[int, float]]:
        """(id, a) of a context's successors, by its pointers."""
        at, hit = self.contexts.successor(np.array([context]))
        if not hit[0]:
            return []
        start, end = self.pointers.access(np.array([at[0], at[0] + 1])).tolist()
        i = np.arange(start, end)
        ids = self.words.access(i) - np.uint64(int(at[0]) * self.size)
        return list(zip(ids.tolist(), self.a[self.codes[i]].tolist(), strict=True))


@dataclass
class Model:
    vocabulary: Vocabulary
    path: str
    shards: int
    made: list[tuple[int, int]]  # (order, shard) of the files there are

    def level(self, order: int, shard: int) -> Level | None:
        if not hasattr(self, "opened"):
            self.opened, self.have = Opened(self.path), set(self.made)
        if (order, shard) not in self.have:
            return None
        return self.opened.get(f"level-{order}-{shard:06d}", lambda arrays: Level(arrays, self.vocabulary.size))

    def score(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of each text."""
        v = self.vocabulary
        hashes, lengths = tokens(texts)
        run = Run.of(hashes, lengths)
        ids, counts = v.find(run.hashes)
        base = (counts + 0.5) / (v.tokens + 0.5 * (v.size + 1))
        p = base[run.kind]
        # distinct contexts of the level: the words of their kinds; each token's context before it, or -1
        words, before = [ids], np.where(run.place > 0, np.concatenate([[0], run.kind[:-1]]), -1)
        before[before >= 0] = np.where(ids[before[before >= 0]] >= 0, before[before >= 0], -1)
        for order in ORDERS:
            at = np.flatnonzero(before >= 0)
            key, back = np.unique(before[at] * len(ids) + run.kind[at], return_inverse=True)
            owner, word = np.divmod(key, max(1, len(ids)))
            b, a, more = self.weights(order, context_of(words, v.size), owner, ids[word])
            p[at] = a[back] + b[owner][back] * p[at]
            if order < ORDERS[-1]:
                words = [*[w[owner] for w in words], ids[word]]
                seen = np.full(len(p), -1)
                seen[at] = np.where(more, np.arange(len(key)), -1)[back]
                before = np.where(run.place > order - 1, np.concatenate([[-1], seen[:-1]]), -1)
        first = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, first)
        return lengths, add((counts > 0).astype(np.int64)[run.kind]), add(np.log10(base)[run.kind]), add(np.log10(np.minimum(p, 1.0)))

    def weights(self, order: int, contexts: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level.weights over the level's shards; owners are sorted."""
        b, a, more = np.ones(len(contexts)), np.zeros(len(word)), np.zeros(len(word), bool)
        asked = np.flatnonzero(np.bincount(owner, minlength=len(contexts)))
        shard = shard_of(contexts[asked], self.shards)
        by = asked[np.argsort(narrow(shard), kind="stable")]
        starts, ends = np.searchsorted(owner, by), np.searchsorted(owner, by, "right")
        for i, x, y in stretches(np.sort(shard)):
            if (here := self.level(order, i)) is None:
                continue
            n = ends[x:y] - starts[x:y]
            at = np.repeat(starts[x:y] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            b[by[x:y]], a[at], more[at] = here.weights(contexts[by[x:y]], np.repeat(np.arange(y - x), n), word[at])
        return b, a, more


def train(docs: DataFrame) -> Model:
    """Fit on the text of every row of docs; a null text is empty. Writes the model to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = shared_dir(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(chars / 6 // SHARD_TOKENS, 1 << 20)))
    vocabulary = count_words(texts, out, max(1, (shards - 1).bit_length()))
    release(spark)
    size, step = vocabulary.size, width(shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            run = Run.of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            ids, _ = vocabulary.find(run.hashes)
            rows = []
            for order in ORDERS:
                words, n = run.ngrams(order)
                words = [ids[w] for w in words]
                context = context_of(words[:-1], size)
                rows += cut(shard_of(context, shards) // step, [context, words[-1], n], order)
            parts.clear()
            return sent(rows)

        for batch in batches:
            for _, part in chunks(batch.column(0).cast(pa.binary()).to_pylist()):
                parts.append(tokens(part))
                held += len(parts[-1][0])
                if held >= RUN_TOKENS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for i, order, arrays in blobs(batches):
            held.setdefault((order, i), []).append(opened(order, arrays))
        for (order, i), parts in sorted(held.items()):
            context, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            (context, word), n = summed([context, word], n)
            if len(n):
                put(out, f"level-{order}-{i:06d}", level(context, word, n, size))
                yield pa.RecordBatch.from_pylist([{"ngram": order, "shard": i}])

    form = Format(opened, closed, lambda kind, columns: shard_of(columns[0], shards))
    made = dealt(texts.mapInArrow(count, SENT), shards, form).mapInArrow(build, "ngram long, shard long").collect()
    release(spark)
    return Model(vocabulary, out, shards, [(r["ngram"], r["shard"]) for r in made])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held, n_tokens, n_known, base_score, score) of every row of docs (doc_id, text, held). A null or empty text has its end only. Repeated rows score alike; docs have no other columns. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1).cast(pa.binary()).to_pylist(), SCORE_CHARS):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x) for x in model.score(texts))], names=["doc_id", "held", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 1


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every text of `documents` by a model of those that are not held out; see scored.

    A null or empty text is its end alone. A null doc_id counts as remainder 0 and so is learned from. Repeated rows
    are learned from as often as they occur and score alike. Other columns are ignored; where nothing is learned, a
    score is 0 for each token; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    done = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held")), model)
    return done.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
