"""Toxicity (operator 5): subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its hashed character n-grams (so an unseen misspelling shares
most of them), a stretch of SPAN words averages its words' vectors, and a two-class softmax on that average
gives the stretch's probability. A document has the probability of its most toxic stretch: an insult in a long
text is not averaged away. Embeddings and softmax are trained jointly in numpy by full-batch gradient steps with momentum on a
bounded sample of labelled rows: at most POSITIVES and NEGATIVES of them, chosen by the hash of doc_id.

As everything up to the softmax is linear, scoring needs one number for each n-gram bucket: its embedding's
product with the difference of the two classes' weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import chunks, crc_mod, table
from lodewell.llm.ngrams import Words

ORDERS, BUCKETS, DIM, SPAN = (3, 4, 5, 6), 1 << 17, 8, 20
POSITIVES, NEGATIVES, SAMPLE_CHARS = 1_200, 2_400, 12_000_000
AVERAGED_STEPS, STEPS, RATE, MOMENTUM, DECAY = 20, 200, 10.0, 0.9, 1e-5
#: A bucket of n-grams takes part in training if so many words of the sample's texts have it; others add nothing to a score.
LEAST_WORDS = 2
#: Toxic rows weigh so much of the loss together, clean ones the rest.
TOXIC_WEIGHT = 0.8
#: The bias stays below, so that a text of which nothing is known is clean.
MOST_BIAS = -0.5


def spans(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each stretch, and the stretch's text: SPAN words each, a shorter rest joining the one before if it is under half."""
    counts = np.bincount(owner, minlength=texts)
    n = np.where(counts > 0, np.maximum(1, (counts + SPAN // 2) // SPAN), 0)
    text = np.repeat(np.arange(texts), n)
    order = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + order * SPAN, text


@dataclass
class Model:
    #: A bucket's product with the difference of the classes' weights; the difference of their biases.
    product: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Each text's log odds; a text without words has the bias alone."""
        words, out = Words(texts), np.full(len(texts), self.bias)
        if not words.count:
            return out
        total, size = np.zeros(words.count), np.zeros(words.count)
        for n in ORDERS:
            word, bucket = words.grams(n, BUCKETS)
            total += np.bincount(word, self.product[bucket], words.count)
            size += np.bincount(word, minlength=words.count)
        value = total / np.maximum(size, 1)
        first, text = spans(words.owner, len(texts))
        mean = np.add.reduceat(value, first) / np.diff(np.append(first, words.count))
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, mean)
        return np.where(np.isfinite(best), best + self.bias, out)


def frequent(owner: np.ndarray, kind: np.ndarray, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Buckets that enough words have; a text counts once for each of its words."""
    texts_of = np.bincount(np.unique(owner.astype(np.int64) * (int(kind.max()) + 1) + kind) % (int(kind.max()) + 1))
    return np.bincount(bucket, texts_of[word], BUCKETS) >= LEAST_WORDS


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Fit on texts and labels 0 or 1. Without both labels, every text scores the share of label 1."""
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if len(toxic) and toxic[0] else -20.0)
    words = Words(texts)
    kind, example = words.distinct()
    is_example = np.zeros(words.count, bool)
    is_example[example] = True
    kinds, grams = len(example), []
    for n in ORDERS:
        word, bucket = words.grams(n, BUCKETS)
        keep = is_example[word]
        grams.append((kind[word[keep]], bucket[keep]))
    word, bucket = (np.concatenate([g[i] for g in grams]).astype(np.int32) for i in (0, 1))
    del grams
    words.x = words.letter = words.index = None  # of use for n-grams only
    share = 1 / np.maximum(np.bincount(word, minlength=kinds), 1)
    common = frequent(words.owner, kind, word, bucket)
    word, bucket = word[common[bucket]], bucket[common[bucket]]
    first, text = spans(words.owner, len(texts))
    length = np.diff(np.append(first, words.count))
    heads = np.flatnonzero(np.diff(text, prepend=-1))
    held = text[heads]  # texts that have words
    y = toxic[held].astype(np.float64)
    weigh = np.where(y > 0, TOXIC_WEIGHT / max(1, y.sum()), (1 - TOXIC_WEIGHT) / max(1, (1 - y).sum()))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    v, b = rng.normal(0, 0.5, DIM).astype(np.float32), 0.0
    # rare buckets take longer steps: each by the root of how seldom the sample's words have it
    often = np.bincount(bucket, np.bincount(kind, minlength=kinds)[word], BUCKETS)
    pace = np.sqrt(often.max() / np.maximum(often, 1)).astype(np.float32)
    speed_e, speed_v, speed_b = np.zeros_like(e), np.zeros_like(v), 0.0
    per_text = np.diff(np.append(heads, len(text)))
    for i in range(1, STEPS + 1):
        value = (np.bincount(word, (e @ v)[bucket], kinds) * share)[kind]
        mean = np.add.reduceat(value, first) / length
        if i <= AVERAGED_STEPS:
            logit = np.add.reduceat(mean, heads) / per_text + b
        else:
            top = np.maximum.reduceat(mean, heads)
            logit = top + b
        grad = weigh * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        if i <= AVERAGED_STEPS:
            span_grad = np.repeat(grad / per_text, per_text)
        else:
            hit = mean >= np.repeat(top, per_text)
            span_grad = np.where(hit, np.repeat(grad, per_text), 0) / np.maximum(np.repeat(np.add.reduceat(hit, heads), per_text), 1)
        word_grad = np.bincount(kind, np.repeat(span_grad / length, length), kinds) * share
        bias_grad = grad.sum()
        bucket_grad = np.bincount(bucket, word_grad[word], BUCKETS).astype(np.float32)
        for x, speed, grad in ((e, speed_e, (pace * bucket_grad)[:, None] * v), (v, speed_v, bucket_grad @ e)):
            step = RATE * (grad + DECAY * x)
            speed *= MOMENTUM
            speed -= step * min(1.0, 0.2 / (float(np.abs(step).max()) + 1e-12))
            x += speed
        b = min(b + speed_b, MOST_BIAS)
        speed_b = MOMENTUM * speed_b - 0.05 * RATE * float(bias_grad)
    product = (e @ v).astype(np.float32)
    product[often == 0] = 0  # never trained: still at its random start
    return Model(product, float(b))


def fit(labelled: DataFrame) -> Model:
    """Fit on (doc_id, text, toxic); rows without a text or a label are left out."""
    rows = labelled.where("toxic IN (0, 1) AND text IS NOT NULL")
    counts = {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, POSITIVES / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, NEGATIVES / max(1, counts.get(0, 0)))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = rows.where(unit < share).select(unit.alias("u"), "text", F.col("toxic").cast("int").alias("toxic"), F.length("text").alias("n")).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    taken = bounded((r.u, r.text, r.toxic) for r in picked.orderBy("n", "u", "text").toLocalIterator())
    return train([t for _, t, _ in taken], np.array([y for _, _, y in taken], np.int64))


def bounded(rows: Iterable[tuple[float, str, int]]) -> list[tuple[float, str, int]]:
    """Rows (unit, text, label), shortest first, in the order of their units and within SAMPLE_CHARS.

    Where they do not fit, each label has half the room and what the other leaves, and gives up its longest texts
    one by one; its shortest stays, cut to the room. So no text ends the sample, and no label takes the other's place.
    """
    held, size, full = {0: [], 1: []}, {0: 0, 1: 0}, {0: False, 1: False}
    for r in rows:
        _, text, label = r
        full[label] |= bool(held[label]) and size[label] + len(text) > SAMPLE_CHARS
        if all(full.values()):
            break
        if not full[label]:
            held[label].append(r)
            size[label] += len(text)
    rooms = {label: max(SAMPLE_CHARS // 2, SAMPLE_CHARS - size[1 - label]) for label in held}
    for label, room in rooms.items():
        while len(held[label]) > 1 and size[label] > room:
            size[label] -= len(held[label].pop()[1])
        if size[label] > room:
            u, text, _ = held[label][0]
            held[label] = [(u, text[:room], label)]
    return sorted(held[0] + held[1], key=lambda r: r[:2])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and toxic_score (0 to 1) of every row's whole text; null and empty texts score by the bias alone. Repeated rows score alike. Map-only; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist()):
                p = 1 / (1 + np.exp(-np.clip(shared.value.logits(texts), -40, 40)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(p, pa.float64())], names=["doc_id", "toxic_score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, toxic_score double")


def held_out() -> Column:
    return crc_mod("doc_id", 5) == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text of `documents`, learned from `labels` of the rows that are not held out; see score.

    A null text is the empty one and scores by the bias alone. Null labels teach nothing; of repeated labels of one
    doc_id the toxic one holds. A null doc_id has no label and counts as remainder 0. Repeated rows score alike. Other
    columns are ignored; without labels every text scores near 0; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(sampled(docs, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with labels, by a broadcast of no more label rows than the sample needs."""
    counts = {int(r[0]): r[1] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, POSITIVES / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, NEGATIVES / max(1, counts.get(0, 0)))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(55)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.join(F.broadcast(labels.where(unit < share)), "doc_id")
