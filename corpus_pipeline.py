"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes and returns documents (the last: their token digests), works on all rows that the stage before
kept, and leaves the columns of documents as they are, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import bpe, langid, mixing, neardup, substring
from lodewell.llm.common import stored


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text is not in the language that `lang` states, as predicted from the text alone, and documents of no language (null texts and texts without a letter).

    A null lang, or one too rare to be learned, is no statement: such documents stay if their text is of any language.
    Where nothing can be learned (no row has both), nothing is predicted and only a letter is asked for. Repeated
    rows are judged alike; other columns pass through; an empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    learned = F.array(*map(F.lit, model.languages))
    stated = F.col("lang").isNotNull() & F.array_contains(learned, F.col("lang"))
    kept = (F.col("lang_pred") != "und") & (~F.coalesce(stated, F.lit(False)) | (F.col("lang") == F.col("lang_pred")))
    return langid.identify(docs, model).where(kept).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that of the smallest doc_id.

    Repeated rows, and rows that differ in other columns only, are copies: one stays. Of ties in doc_id one row
    stays, as of a group whose ids are null. Null, empty and blank texts are no copies of each other and stay.
    """
    return neardup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that repeat, every occurrence; a text without one stays as it is, null included, and a document of nothing else goes.

    A changed text is its kept words joined by one space, and n_chars (if there is one) is its length. Repeated rows
    are each other's repeats. Other columns pass through.
    """
    done = substring.remove(docs)
    changed = F.col("__lw_removed") > 0
    text = F.when(changed, F.col("__lw_kept")).otherwise(F.col("text"))
    put = {"text": text, "n_chars": F.when(changed, F.length("__lw_kept").cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    kept = done.where(~changed | (F.col("__lw_removed") < F.col("__lw_words")))
    return kept.select(*[put[c].alias(c) if put.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as its source's weight asks for: none, one or two equal rows.

    A null source is one of its own, the last. A null or empty text has no words and stays once where its source's
    rate is 1 or its coin falls so. Repeated rows fall alike. Other columns pass through; an empty table stays empty.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; returns doc_id, its token count and the digests of ids and decoded bytes.

    A row for each row of docs, repeated ones too. A null text is the empty text, which has no ids. Other columns go.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]
#: Language identification and byte-pair merging have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
