"""Document fingerprints (operator 1): Merkle trees over sections, paragraphs and their pieces, in DataFrame functions only.

A text is split into sections at blank lines, sections into paragraphs at line breaks, paragraphs into pieces
at the ends of clauses (64 code points at most before them, so that likeness follows the unchanged part in short texts too). Each split can be undone, so a tree of sha256 hashes over them has
equal roots for equal texts only. Differing nodes show where two texts differ; the share of pieces that two
trees have in common is their likeness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.llm.common import table

PIECE = r"[^.!?,;:]{1,64}[.!?,;:]*|[.!?,;:]{1,64}"
#: Rows of a bucket of neighbouring ids, about; buckets at most, which bounds what is broadcast and sent to the driver.
BUCKET_ROWS, QUANTILES, MOST_BUCKETS = 512, 4096, 1 << 16
FAN = 64


def pieces(text: Column) -> Column:
    """Hashes of a text's pieces, nested by section and paragraph; null counts as empty."""
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))
    section = lambda s: F.transform(F.split(s, "\n", -1), paragraph)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)


def joined(hashes: Column) -> Column:
    return F.sha2(F.concat_ws("", hashes), 256)


def paragraphs(tree: Column) -> Column:
    """Paragraph nodes, nested by section."""
    return F.transform(tree, lambda s: F.transform(s, joined))


def sections(tree: Column) -> Column:
    return F.transform(paragraphs(tree), joined)


def root(tree: Column) -> Column:
    return joined(sections(tree))


def leaves(tree: Column) -> Column:
    """The distinct pieces of a tree, by 64 bits of their hashes."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda h: F.substring(h, 1, 16)))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves, twice, over all leaves of both: 1 for equal texts (two empty ones too), 0 where nothing is shared."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / n)


def differing(a: Column, b: Column) -> Column:
    """Places (section, paragraph), from 0, of tree a whose paragraph has no equal in tree b: the branches that hold an edit."""
    others = F.flatten(paragraphs(b))
    places = F.transform(paragraphs(a), lambda s, i: F.filter(F.transform(s, lambda h, j: F.struct(i.alias("section"), j.alias("paragraph"), h.alias("hash"))), lambda x: ~F.array_contains(others, x["hash"])))
    return F.flatten(places)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint` (the root's hash) and `tree`; columns of those names are replaced. No shuffle."""
    return docs.withColumn("tree", pieces(F.col("text"))).withColumn("fingerprint", root(F.col("tree")))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, ...) with a bucket of neighbouring ids: about equal quantiles, each cut into equal widths."""
    n, low = docs.agg(F.count("*"), F.min("doc_id")).first()
    quantiles = max(1, min(QUANTILES, n // BUCKET_ROWS))
    cuts = max(1, min(n // (BUCKET_ROWS * quantiles), MOST_BUCKETS // quantiles))
    probabilities = [i / quantiles for i in range(quantiles)]
    splits = sorted({low, *(docs.agg(F.percentile_approx("doc_id", probabilities, 10 * QUANTILES)).first()[0] or [])}) if low is not None else []
    if not splits:
        return docs.withColumn("bucket", F.lit(-1).cast("long"))
    literal = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    groups = [splits[i : i + FAN] for i in range(0, len(splits), FAN)]
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= F.col("doc_id")))
    out = docs.withColumn("__lw_group", below(literal([g[0] for g in groups])))
    out = out.withColumn("bucket", ((F.col("__lw_group") - 1) * FAN + below(F.element_at(F.array(*map(literal, groups)), F.greatest(F.col("__lw_group"), F.lit(1))))).cast("long"))
    if cuts > 1:
        widths = literal([max(1, (b - a) // cuts + 1) for a, b in zip(splits, [*splits[1:], splits[-1] + BUCKET_ROWS], strict=True)])
        at = F.greatest(F.col("bucket"), F.lit(1)).cast("int")
        far = F.col("doc_id").cast("double") - F.element_at(literal(splits), at).cast("double")  # differences of longs may overflow
        cut = F.least(far / F.element_at(widths, at), F.lit(cuts - 1))
        out = out.withColumn("bucket", F.col("bucket") * cuts + F.floor(cut).cast("long"))
    return out.withColumn("bucket", F.coalesce("bucket", F.lit(-1))).drop("__lw_group")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with `following`: the next row's text by descending doc_id (null ids last, equal ids by text), the first row's after the last.

    Rows move once, to buckets of neighbouring ids; a bucket's first rows are also sent to the bucket before, to
    close its end. Only a bounded table of the buckets' first ids is collected and broadcast.
    """
    spark = docs.sparkSession
    rows = bucketed(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    heads = sorted(rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: -r["bucket"])
    closing = [(r["head"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]
    ends = F.broadcast(spark.createDataFrame(closing, "head long, goes_to long"))
    guests = rows.join(ends, rows["doc_id"].eqNullSafe(ends["head"])).select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(1).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    return both.withColumn("following", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "following")


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses; see op1 for the columns.

    Empty and null texts have the fingerprint of the empty text. Repeated rows each keep a row. An empty table gives an empty result.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("following"), F.lit(1), half)))
    trees = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[pieces(F.col(c)).alias(c) for c in ("text", "edited", "following")])
    known = trees.select("doc_id", "n_chars", "edited_sha256", root(F.col("text")).alias("fingerprint"), root(F.col("edited")).alias("edited_fingerprint"), *[leaves(F.col(c)).alias(c) for c in ("text", "edited", "following")])
    return known.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("following")).alias("near_next"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of `documents` and of its edited text; see edited_against_next.

    A null text is the empty one. The next document is the next row by descending doc_id: null ids last, equal ids by
    text, rows that are equal altogether in any order. Other columns are ignored; an empty table gives no rows.
    """
    return edited_against_next(table(spark, sf_dir, "documents"))


def _sql() -> str:
    tree = "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '" + PIECE + "'), lambda x: sha256(x))))"
    up = "list_transform({0}, lambda s: sha256(coalesce(array_to_string(list_transform(s, lambda p: sha256(coalesce(array_to_string(p, ''), ''))), ''), '')))"
    top = "sha256(array_to_string(" + up + ", ''))"
    leaf = "list_distinct(list_transform(flatten(flatten({0})), lambda h: h[1:16]))"
    like = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE CAST(2 * len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1})) END"
    put = lambda form, *args: reduce(lambda s, a: s.replace("{%d}" % a[0], a[1]), enumerate(args), form)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, lead(t) OVER w AS ahead, first_value(t) OVER w AS head FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t)),
e AS (SELECT doc_id, t, coalesce(ahead, head) AS f, substr(t, 1, length(t) - length(t) // 2) || substr(coalesce(ahead, head), 1, length(t) // 2) AS ed FROM o),
p AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, {put(tree, 't')} AS a, {put(tree, 'ed')} AS b, {put(tree, 'f')} AS c FROM e),
l AS (SELECT doc_id, n_chars, edited_sha256, {put(top, 'a')} AS fingerprint, {put(top, 'b')} AS edited_fingerprint, {put(leaf, 'a')} AS a, {put(leaf, 'b')} AS b, {put(leaf, 'c')} AS c FROM p)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {put(like, 'a', 'b')} AS near_edited, {put(like, 'a', 'c')} AS near_next FROM l
"""


ORACLE_OP1 = _sql()
