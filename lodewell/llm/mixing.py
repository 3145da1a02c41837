"""Mixing sources to target weights (operator 3).

Words are counted per source, targets come by filling sources up to a multiple of their size, and a source's
repetition rate is target / size. Each document is emitted floor(rate) times plus one hash-seeded Bernoulli
copy with probability rate - floor(rate). A source's coins come from one of SEEDS hash seeds: the one whose
copies come nearest to the target, chosen in the same aggregate that would evaluate a single seed. Nothing is
shuffled but partial sums and a source table.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import WORD_PATTERN, drop, stored, table

WEIGHTS, SHARE, CAP, SEEDS = (5, 2, 1), Fraction(3, 2), 2, 32
BITS = 48
#: A source table of at most so many rows is broadcast; a larger one is joined by source and salt.
BROADCAST_ROWS, SALTS = 20_000, 32


def size_of(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def coin(doc_id: str, seed: Column) -> Column:
    """A uniform integer below 2^48 from the document's id and a seed; a null id draws as the text null."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, BITS // 4), 16, 10).cast("long")
    return F.pmod(part(1) + seed * part(1 + BITS // 4), F.lit(1 << BITS))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their position by code point, null last; a distributed sort, however many there are."""
    rows = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return sources.sparkSession.createDataFrame(rows, "source string, source_size long, position long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: share of all words by weight, at most cap times a source's size, the excess shared anew until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    table_ = stored(ranked(sources).withColumn("weight", weight))
    per_weight = F.col("source_size") / F.col("weight")
    total, left, open_weight, level, capped = None, Fraction(0), 0, None, -1
    while True:
        above = F.lit(False) if level is None else per_weight < F.lit(float(level))
        got = table_.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        total = share * (got[0] or 0)
        if got[3] == capped:
            break
        capped, left, open_weight = got[3], total - cap * got[1], got[2]
        if not open_weight:
            break
        level = left / (cap * open_weight)
    even = F.lit(float(left)) * F.col("weight") / F.lit(float(max(1, open_weight)))
    most = (F.lit(cap) * F.col("source_size")).cast("double")
    return table_.select("source", "source_size", F.least(even, most).alias("target") if open_weight else most.alias("target"))


def with_source(docs: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the sources' columns; a hot source is spread over salts where the source table is too large to broadcast."""
    wanted = sources.select(F.col("source").alias("__lw_source"), *[F.col(c).alias(f"__lw_{c}") for c in columns])
    on = docs["source"].eqNullSafe(F.col("__lw_source"))
    if sources.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(wanted), on)
    salted = docs.withColumn("__lw_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")))
    spread = wanted.withColumn("__lw_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, salted["source"].eqNullSafe(F.col("__lw_source")) & (F.col("__lw_salt") == F.col("__lw_at"))).drop("__lw_salt", "__lw_at")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """For each source of (doc_id, source, __lw_size): source_size, target, whole copies, the fraction as a 48-bit threshold, the seed."""
    sums = stored(sized.groupBy("source").agg(F.sum("__lw_size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = stored(targets(sums, weights, share, cap).withColumn("whole", F.floor(rate).cast("long")).withColumn("part", (rate - F.floor(rate)) * F.lit(float(1 << BITS))))
    joined = with_source(sized, aims, ["target", "whole", "part", "source_size"])
    h, size = coin("doc_id", F.lit(0).cast("long")), F.col("__lw_size")
    step = F.pmod(coin("doc_id", F.lit(1).cast("long")) - h, F.lit(1 << BITS))
    tossed = joined.select("source", "__lw_target", "__lw_whole", "__lw_part", "__lw_source_size", size, h.alias("__lw_h"), step.alias("__lw_step"))
    taken = lambda m: F.sum(F.when(F.pmod(F.col("__lw_h") + F.lit(m) * F.col("__lw_step"), F.lit(1 << BITS)) < F.col("__lw_part"), size).otherwise(0))
    by = tossed.groupBy("source").agg(*[F.first(f"__lw_{c}").alias(c) for c in ("source_size", "target", "whole", "part")], *[taken(m).alias(f"__lw_{m}") for m in range(SEEDS)])
    off = F.array_min(F.array(*[F.struct(F.abs((F.col("whole") * F.col("source_size") + F.col(f"__lw_{m}")).cast("double") - F.col("target")).alias("d"), F.lit(m).alias("m")) for m in range(SEEDS)]))
    out = stored(by.select("source", "source_size", "target", "whole", "part", off["m"].cast("long").alias("seed")))
    drop(sums, aims)
    return out


def decided(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with __lw_source_size, __lw_target and __lw_copies."""
    joined = with_source(sized, sources, ["source_size", "target", "whole", "part", "seed"])
    copies = F.col("__lw_whole") + F.when(coin("doc_id", F.col("__lw_seed")) < F.col("__lw_part"), 1).otherwise(0)
    return joined.withColumn("__lw_copies", copies.cast("long")).drop("__lw_source", "__lw_whole", "__lw_part", "__lw_seed")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """The mixed corpus: every row of docs as often as it is taken, with docs' columns.

    Sources are weighed by `weights`, repeating, in code point order, a null source last. A document never comes
    more than ceil(rate) <= cap times. Rows of one doc_id and source share a coin. Empty and null texts have size
    0 and are taken at their source's rate; a source of size 0 is not taken. An empty table gives an empty one.
    """
    sized = docs.select("doc_id", "source", size_of().alias("__lw_size"))
    sources = rates(sized, weights, share, cap)
    out = decided(docs, sources)
    return out.withColumn("__lw_copy", F.explode(F.array_repeat(F.lit(0), F.col("__lw_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all `documents` takes of each row; see mix.

    A null text has size 0; a null source is one of its own, the last. Rows of one doc_id and source fall alike, so
    repeated rows do. Other columns are ignored; an empty table gives no rows.
    """
    sized = stored(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), size_of().alias("__lw_size")))
    done = decided(sized, rates(sized))
    return done.select("doc_id", F.col("__lw_size").alias("size"), F.col("__lw_source_size").alias("source_size"), F.col("__lw_target").alias("target"), (F.col("__lw_size") * F.col("__lw_copies")).alias("taken"))


ORACLE_OP3 = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 13, 12) AS BIGINT) AS step FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS r2,
    CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS ww FROM s),
c AS (SELECT *, r2 * w > 4 * source_size * ww AS capped FROM o),
f AS (SELECT CAST(max(3 * total) - 4 * coalesce(sum(source_size) FILTER (capped), 0) AS DOUBLE) / 2 AS r, CAST(coalesce(sum(w) FILTER (NOT capped), 1) AS DOUBLE) AS ow FROM c, (SELECT sum(source_size) AS total FROM s)),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE least(r * w / ow, CAST(2 * source_size AS DOUBLE)) END AS target FROM c, f),
a AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
p AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, (rate - floor(rate)) * {1 << BITS}.0 AS part FROM a),
m AS (SELECT p.source, seed, abs(CAST(any_value(whole) * any_value(source_size) + sum(CASE WHEN (h + seed * step) % {1 << BITS} < part THEN size ELSE 0 END) AS DOUBLE) - any_value(target)) AS off
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, (SELECT unnest(range({SEEDS})) AS seed) GROUP BY p.source, seed),
b AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM m GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN (h + seed * step) % {1 << BITS} < part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
