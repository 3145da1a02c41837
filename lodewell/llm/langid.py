"""Language identification (operator 10): the family first, then one-versus-one linear SVMs within it.

A text's features are relative frequencies of hashed character n-grams of its words. The classifiers are fitted
on a bounded sample of labelled rows (SAMPLE_ROWS in expectation, the same number for every language that has
them; of the MOST_LANGS commonest languages); predictions read every whole text. Training and prediction never see lang, source or doc_id as inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import chunks, crc_mod, table
from lodewell.llm.ngrams import Words

ORDERS, BUCKETS, SAMPLE_ROWS, MOST_LANGS, STEPS, C = (1, 2, 3, 4), 1 << 13, 2_400, 200, 200, 300.0
#: The value of the features' last column, which stands for the bias.
BIAS = 0.3
#: Language families by ISO 639-1 code. A code of no family is one of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la co",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn ur pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(texts: list[str]) -> np.ndarray:
    """A row of relative n-gram frequencies for each text, each order weighing the same."""
    words, out = Words(texts), np.zeros((len(texts), BUCKETS), np.float32)
    for n in ORDERS:
        word, bucket = words.grams(n, BUCKETS)
        counts = np.bincount(words.owner[word] * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        out += counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias's) that minimise the squared hinge loss, y in {-1, 1}, classes weighing the same; accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 / C + 2 * float(np.einsum("ij,ij->i", x, x).max()))
    for i in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (v / C - 2 * (x.T @ (share * y * slack)))
        w, v = step, step + i / (i + 3) * (step - w)
    return w


@dataclass
class Model:
    """Column k of `weights` scores classifier k; families and languages point to theirs."""

    weights: np.ndarray
    families: list[tuple[str, int]]  # one against the rest; -1 where there is one family only
    pairs: dict[str, list[tuple[str, str, int]]] = field(default_factory=dict)
    single: dict[str, str] = field(default_factory=dict)

    @property
    def languages(self) -> list[str]:
        """All that can be predicted, but for `und`."""
        return sorted({*self.single.values(), *(x for p in self.pairs.values() for a, b, _ in p for x in (a, b))})

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's margin for each classifier, and whether it has a letter."""
        words, k = Words(texts), self.weights.shape[1]
        out = np.tile(BIAS * self.weights[-1], (len(texts), 1)).astype(np.float64)
        for n in ORDERS:
            word, bucket = words.grams(n, BUCKETS)
            owner = words.owner[word]
            total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
            for j in range(k):
                out[:, j] += np.bincount(owner, self.weights[bucket, j], len(texts)) / total
        return out, np.bincount(words.owner, minlength=len(texts)) > 0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.families:
            return ["und"] * len(texts), [0.0] * len(texts)
        margins, has = self.margins(texts)
        score, choice = np.where(has, 1.0, 0.0), np.zeros(len(texts), np.int64)
        if len(self.families) > 1:
            m = margins[:, [k for _, k in self.families]]
            e = np.exp(2 * (m - m.max(1, keepdims=True)))
            choice, score = m.argmax(1), score * e.max(1) / e.sum(1)
        langs = np.full(len(texts), "und", object)
        for i, (name, _) in enumerate(self.families):
            rows = np.flatnonzero(has & (choice == i))
            if name in self.single:
                langs[rows] = self.single[name]
            elif len(rows):
                best, sure = self.within(name, margins[rows])
                langs[rows] = best
                score[rows] *= sure
        return langs.tolist(), score.tolist()

    def within(self, name: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of a family that wins most of its duels (then by the sum of its margins, then by name) in each row, and how sure its closest duel is."""
        pairs = self.pairs[name]
        members = sorted({x for a, b, _ in pairs for x in (a, b)})
        won, total, close = (np.zeros((len(margins), len(members))) for _ in range(3))
        close += np.inf
        for a, b, k in pairs:
            for lang, margin in ((members.index(a), margins[:, k]), (members.index(b), -margins[:, k])):
                won[:, lang] += margin > 0
                total[:, lang] += margin
                close[:, lang] = np.minimum(close[:, lang], np.abs(margin))
        lead = won == won.max(1, keepdims=True)
        best = np.where(lead, total, -np.inf).argmax(1)
        return np.array(members, object)[best], 1 / (1 + np.exp(-2 * close[np.arange(len(best)), best]))


def train(langs: list[str], x: np.ndarray) -> Model:
    known, lang = sorted(set(langs)), np.array(langs, object)
    of = {a: family(a) for a in known}
    names, columns = sorted(set(of.values())), []

    def add(mask: np.ndarray, y: np.ndarray) -> int:
        columns.append(fit_svm(x[mask], y[mask].astype(np.float32)))
        return len(columns) - 1

    every = np.ones(len(langs), bool)
    fam = np.array([of[a] for a in langs], object)
    families = [(f, add(every, np.where(fam == f, 1, -1)) if len(names) > 1 else -1) for f in names]
    pairs, single = {}, {}
    for f in names:
        members = [a for a in known if of[a] == f]
        if len(members) == 1:
            single[f] = members[0]
        else:
            pairs[f] = [(a, b, add((lang == a) | (lang == b), np.where(lang == a, 1, -1))) for a, b in combinations(members, 2)]
    return Model(np.stack(columns, 1) if columns else np.zeros((BUCKETS + 1, 0), np.float32), families, pairs, single)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows of docs that have a text and a lang (of the MOST_LANGS commonest ones); about rows / languages of each, by the hash of doc_id. Features travel to the driver as their non-zero places and values."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    each = rows / max(1, len(counts))
    share = F.create_map(*[c for lang, n in counts.items() for c in (F.lit(lang), F.lit(min(1.0, each / n)))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = labelled.where(unit < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist(), 1 << 19):
                x = features(texts)
                at = [np.flatnonzero(row).astype("<u2") for row in x]
                yield pa.RecordBatch.from_arrays([langs.slice(first, len(texts)), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([row[i].astype("<f4").tobytes() for row, i in zip(x, at, strict=True)], pa.binary())], names=["lang", "places", "x"])

    got = sorted((r.lang, bytes(r.places), bytes(r.x)) for r in picked.mapInArrow(run, "lang string, places binary, x binary").toLocalIterator())
    x = np.zeros((len(got), BUCKETS + 1), np.float32)
    for row, (_, places, values) in zip(x, got, strict=True):
        row[np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f4")
    x[:, -1] = BIAS
    langs = [r[0] for r in got]
    del got
    return train(langs, x)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, then lang_pred and lang_score (columns of those names are replaced).

    A null text, or one without a letter, is `und` with score 0, as is everything where nothing could be learned.
    Repeated rows are predicted alike; other columns pass through. Map-only.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    text = kept.index("text")
    shape = StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(text).to_pylist()):
                langs, scores = shared.value.predict(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "lang_score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, shape)


def held_out() -> Column:
    return crc_mod("doc_id", 3) == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`, learned from those that are not held out; see identify.

    A null text, or one without a letter, is `und` with score 0, as is everything where no row can be learned from.
    Rows of a null lang teach nothing; a null doc_id counts as remainder 0. Repeated rows are predicted alike. Other
    columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
