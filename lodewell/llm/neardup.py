"""MinHash near-deduplication (operator 8): one-permutation hashing, optimal densification, banded buckets, star edges.

Texts of equal shingle sets form a class, and one row stands for it. Each class has BINS bins, filled by the
smallest hash that falls in each; an empty bin takes the value of the first filled bin in its own fixed random
order, so that bins of similar sets stay equal with the sets' Jaccard similarity. ROWS bins make a band: at a
similarity of 0.8 a pair misses all BANDS with probability (1 - 0.8^8)^64 < 1e-5, far below that above it.

Classes that share a band form a bucket, a star whose centre is the band: its candidate edges are as many as its
members, and the stars' components (clusters) hold every pair that shares a band. A task takes the full shingle sets of a cluster, counts all intersections exactly and returns a spanning
forest of the links. A cluster of many members or shingles is cut: into all pairs of its chunks or into its
buckets (and those into pairs of chunks), whichever ships fewer sets; either way every two classes that share a
band meet in some task, no set is compared by estimate, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import binary, chunks, drop, mix64, release, stored, table
from lodewell.llm.components import components
from lodewell.llm.repeats import Places, repeated
from lodewell.llm.substring import keyed
from lodewell.llm.words import WordHashes

BINS, ROWS = 512, 8
BANDS = BINS // ROWS
SIMILAR = 80
#: Members and shingles that one task compares at once, about; larger groups are cut.
GROUP_MEMBERS, GROUP_SHINGLES = 2_048, 1 << 21
#: A shingle of at most so many members is counted pair by pair, others by a product of matrices, so many at a time.
RARE, COLUMNS = 16, 2_048


def shingle_sets(texts: list[str] | list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, A-Z lower-cased; of fewer words, one of the whole sequence."""
    words = WordHashes(texts, lower=True, hashes=1)
    for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = end - start
        if n >= size:
            h = np.sort(words.windows(np.arange(start, end - size + 1), size, 1)[:, 0])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif n:
            yield words.windows(np.array([start]), n, 1)[:, 0] ^ mix64(np.array([n], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Sketcher:
    def __init__(self):
        rng = np.random.default_rng(20)
        #: Row i: the order in which bin i looks for a filled bin; and each bin's place in that order.
        self.order = rng.permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
        self.place = np.argsort(self.order, axis=1)
        self.weights = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

    def bins(self, shingles: np.ndarray) -> np.ndarray:
        """The densified bins of a non-empty set: filled bins keep their own value, however many there are."""
        h = np.sort(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)))
        at = (h >> np.uint64(64 - 9)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        full, value = at[first], h[first]
        out = np.zeros(BINS, np.uint64)
        if len(full) <= 48:  # the same by another way, faster for few
            out = value[self.place[:, full].argmin(1)]
            out[full] = value
            return out
        out[full] = value
        filled = np.zeros(BINS, bool)
        filled[full] = True
        empty, t = np.flatnonzero(~filled), 0
        while len(empty):
            source = self.order[empty, t]
            hit = filled[source]
            out[empty[hit]] = out[source[hit]]
            empty, t = empty[~hit], t + 1
        return out

    def bands(self, shingles: np.ndarray) -> bytes:
        """The keys of the bands."""
        bins = mix64(self.bins(shingles)).reshape(BANDS, ROWS)
        return mix64((bins * self.weights).sum(1, dtype=np.uint64) ^ self.salts).tobytes()


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)]).view(np.int64).tolist())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """A row for each of docs: its two ids, doc_id, the set's size and two ids, and its band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            for first, texts in chunks(batch.column(3).cast(pa.binary()).to_pylist()):
                n, ids, bands = [], [], []
                for s in shingle_sets(texts, size):
                    n.append(len(s))
                    ids.append(set_ids(s))
                    bands.append(sketcher.bands(s) if len(s) else None)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), binary(bands)], names=["a", "b", "doc_id", "n", "s", "t", "bands"])

    rows = keyed(docs).select(F.col("__lw_a").alias("a"), F.col("__lw_b").alias("b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "a long, b long, doc_id long, n long, s long, t long, bands binary")


def node(s: str = "s", t: str = "t") -> Column:
    return F.concat(F.lpad(F.hex(s), 16, "0"), F.lpad(F.hex(t), 16, "0"))


def band_places(batch: pa.RecordBatch) -> Places:
    every = np.arange(BANDS)
    for s, t, bands in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield s, t, every, np.frombuffer(bands, np.uint64).reshape(-1, 1)


def bucket_rows(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, node) for the bands that classes share: packed positions joined to the classes' band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for bands, found in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                at = np.frombuffer(found, "<i4")
                counts.append(len(at))
                keys.append(np.frombuffer(bands, np.int64)[at])
            if counts:
                back = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(back)], names=["bucket", "node"])

    lists = shared.select(F.col("__lw_a").alias("s"), F.col("__lw_b").alias("t"), "positions")
    return classes.join(lists, ["s", "t"]).select(node().alias("node"), "bands", "positions").mapInArrow(run, "bucket long, node string")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, cluster, n, shingles) of the wanted (node, cluster, n, a, b), from the text of the row (a, b) that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(3).cast(pa.binary()).to_pylist()):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], binary([s.tobytes() for s in shingle_sets(texts, size)])], names=["node", "cluster", "n", "shingles"])

    rows = keyed(docs).select(F.col("__lw_a").alias("a"), F.col("__lw_b").alias("b"), F.col("text").cast("string").alias("text"))
    picked = rows.join(wanted, ["a", "b"]).dropDuplicates(["a", "b", "node"]).select("node", "cluster", "n", "text")
    return picked.mapInArrow(run, "node string, cluster string, n long, shingles binary")


def cuts(members: str, shingles: str) -> Column:
    """Into how many chunks a group is cut, so that two of them fit one task; 1 leaves it whole."""
    many = F.greatest(F.ceil(2 * F.col(members) / GROUP_MEMBERS), F.ceil(2 * F.col(shingles) / GROUP_SHINGLES))
    return F.when((F.col(members) <= GROUP_MEMBERS) & ((F.col(shingles) <= GROUP_SHINGLES) | (F.col(members) <= 2)), F.lit(1)).otherwise(F.least(many, F.col(members))).cast("int")


def groups(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(part, node): the tasks' groups of clusters that do not fit one task; members (node, cluster, n) are theirs, rows (bucket, node) any.

    A cluster is cut into all pairs of its chunks or into its buckets (in pairs of chunks where need be), whichever ships fewer sets.
    """
    whole = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total")).withColumn("cut", cuts("m", "total"))
    each = rows.join(members, "node").groupBy("cluster", "bucket").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    # buckets of the same members are one
    one = each.groupBy("cluster", "m", "total", "same").agg(F.min("bucket").alias("bucket")).withColumn("cut", cuts("m", "total"))
    by_bucket = one.groupBy("cluster").agg(F.sum(F.col("m") * F.greatest(F.lit(1), F.col("cut") - 1)).alias("ships"))
    sized = stored(whole.join(by_bucket, "cluster").select("cluster", "cut", (F.col("ships") < F.col("m") * (F.col("cut") - 1)).alias("by_bucket")))

    def parts(df: DataFrame, name: Column) -> DataFrame:
        chunk = F.pmod(F.xxhash64("node", F.lit(8)), F.col("cut")).cast("int")
        pairs = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("cut") - 1), chunk), lambda i: F.concat_ws("-", F.least(i, chunk), F.greatest(i, chunk)))
        one_or_more = F.when(F.col("cut") == 1, F.array(F.lit("-"))).otherwise(pairs)
        return df.select(F.explode(one_or_more).alias("pair"), name.alias("name"), "node").select(F.concat_ws("/", "name", "pair").alias("part"), "node")

    by_cluster = parts(members.join(sized.where("NOT by_bucket"), "cluster"), F.col("cluster"))
    chosen = one.join(sized.where("by_bucket").select("cluster"), "cluster").select("bucket", "cut")
    return by_cluster.unionByName(parts(rows.join(chosen, "bucket"), F.col("bucket").cast("string")))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of every two sets' intersection, as a matrix (its diagonal is of no use)."""
    m = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.append(first, len(every)))
    kind = np.float32 if len(every) < 1 << 24 else np.float64  # counts are exact
    out = np.zeros((m, m), kind)
    rare = np.repeat(count <= RARE, count)
    who, of = owner[rare], every[rare]
    for k in range(1, int(count[count <= RARE].max(initial=1))):
        same = np.flatnonzero(of[k:] == of[:-k])
        if len(same):
            out += np.bincount(who[same] * m + who[same + k], minlength=m * m).reshape(m, m).astype(kind)
    out += out.T
    common = np.flatnonzero(count > RARE)
    for x in range(0, len(common), COLUMNS):
        part = common[x : x + COLUMNS]
        n = count[part]
        at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        has = np.zeros((m, len(part)), kind)
        has[owner[at], np.repeat(np.arange(len(part)), n)] = 1
        out += has @ has.T
    return out


def forest(sets: list[np.ndarray], similar: int) -> np.ndarray:
    """For each set the least index that links lead to."""
    n = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets).astype(np.int64)
    linked = 100 * both >= similar * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None, :], len(sets)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_in(parts: DataFrame, similar: int) -> DataFrame:
    """(u, v): a spanning forest of the links in each group (part, node, shingles), u the first member that v is connected to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, held = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(names) > 1:
                label = forest(held, similar)
                v = np.flatnonzero(label != np.arange(len(names)))
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in label[v].tolist()]), pa.array([names[i] for i in v.tolist()])], names=["u", "v"])

        for batch in batches:
            for p, name, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from close()
                    part, names, held = p, [], []
                names.append(name)
                held.append(np.frombuffer(s, np.uint64))
        yield from close()

    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(partitions, "part").sortWithinPartitions("part", "node").mapInArrow(run, "u string, v string")


def links(docs: DataFrame, classes: DataFrame, size: int, similar: int) -> DataFrame | None:
    """(u, v): links between classes that connect whatever similar classes connect; None if no classes share a band."""
    spark = docs.sparkSession
    shared = repeated(classes.select("s", "t", "bands"), band_places, classes.count() * BANDS)
    rows = stored(bucket_rows(shared, classes))
    release(spark)
    if not rows.limit(1).count():
        return None
    # a bucket's name sorts after those of classes, so that a cluster has a class's name
    clusters = components(rows.select("node", F.concat(F.lit("~"), F.hex("bucket"))).toDF("u", "v")).where("NOT startswith(node, '~')")
    wanted = classes.select(node().alias("node"), "a", "b", "n").join(clusters.withColumnRenamed("label", "cluster"), "node")
    sets = stored(full_sets(docs, wanted, size))
    release(spark)
    large = stored(sets.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where(cuts("m", "total") > 1).select("cluster"))
    if large.limit(1).count():
        members = stored(sets.select("node", "cluster", "n").join(large, "cluster"))
        cut = groups(rows, members).join(sets.select("node", "shingles"), "node").select("part", "node", "shingles")
        small = sets.join(large, "cluster", "left_anti")
    else:
        cut, small = None, sets
    parts = small.select(F.col("cluster").alias("part"), "node", "shingles")
    found = stored(linked_in(parts if cut is None else parts.unionByName(cut), similar))
    drop(rows, sets)
    release(spark)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = SIMILAR) -> DataFrame:
    """A row for each of docs: its ids (a, b), doc_id, n_shingles, component_id, label (of its group; null without shingles).

    Rows link if 100 * intersection >= similar * union of their distinct shingles of `size` words. component_id is
    the smallest doc_id that links lead to, the row's own included; null ids are passed over. Null, empty and
    blank texts have no shingles and link with nothing. Repeated rows link with each other. Other columns of docs
    are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(sketches(docs, size))
    classes = stored(rows.where("n > 0").groupBy("s", "t").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min(F.struct("a", "b", "bands")).alias("x")).select("s", "t", "least", "n", "x.*"))
    release(spark)
    found = links(docs, classes, size, similar)
    named = classes.select("s", "t", node().alias("node"), "least")
    if found is None:
        grouped = named.withColumn("label", F.col("node"))
    else:
        grouped = named.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    grouped = stored(grouped.select("s", "t", "least", "label"))
    ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of = grouped.join(ids, "label").select("s", "t", "label", "component_id")
    out = rows.select("a", "b", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s")).alias("s"), "t").join(of, ["s", "t"], "left")
    return out.select("a", "b", "doc_id", "n_shingles", "label", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, similar: int = SIMILAR) -> DataFrame:
    """docs without near-duplicates, with docs' columns: of each group the row of the smallest doc_id stays.

    Where several rows of a group have that doc_id (or the group has null ids only) one of them stays. Rows
    without shingles all stay, but for repeats of one doc_id and text.
    """
    first = near_duplicates(docs, size, similar).where("doc_id <=> component_id")
    group = F.coalesce("label", F.concat(F.lit("-"), F.hex("a"), F.hex("b")))
    one = first.groupBy(group.alias("g")).agg(F.min(F.struct("a", "b")).alias("x")).select(F.col("x.a").alias("__lw_a"), F.col("x.b").alias("__lw_b"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return keyed(docs).join(one, ["__lw_a", "__lw_b"]).dropDuplicates(["__lw_a", "__lw_b"]).select(*columns)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, as near_duplicates() with shingles of two words; kept marks the row whose doc_id is its group's smallest (null ids: null)."""
    done = near_duplicates(table(spark, sf_dir, "documents"), 2)
    return done.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
