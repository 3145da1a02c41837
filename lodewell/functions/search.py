"""Token, trigram and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(*texts: Column) -> Column:
    """Distinct lower-cased words of the texts (null counts as empty), split at anything but letters, digits and underscores."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.array_distinct(F.filter(F.split(joined, r"(?U)\W+"), lambda x: x != ""))


def has_token(token_list: Column, term: str) -> Column:
    return F.array_contains(token_list, term.lower())


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of a lower-cased text, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def windows(c: Column, size: int = 400, step: int = 300) -> Column:
    """Chunks of `size` words, `step` apart, as an array of texts."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
    kept = F.filter(starts, lambda s: (s == 0) | (s + size - step < F.size(words)))
    return F.transform(kept, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))


def section_chunks(rows: DataFrame, key: str, sections: list[str], size: int = 400, step: int = 300) -> DataFrame:
    """(key, section, chunk, words): each section of a row in chunks of its own, numbered from 0; a section without words has none."""
    every = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).cast("string").alias("text")) for s in sections])
    each = rows.select(key, F.explode(every).alias("x")).select(key, "x.section", "x.text").where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    return each.select(key, "section", F.posexplode(windows(F.col("text"), size, step)).alias("chunk", "words")).withColumn("chunk", F.col("chunk").cast("long"))
