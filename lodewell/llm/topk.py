"""Exact top-k inner-product search by a pivot-distance index (operator 2).

Every vector is keyed by its nearest pivot and its distance to it, so a pivot's vectors lie in rings (annuli)
sorted by distance. For a query q and a ring of pivot p with distances in [lo, hi] and norms up to m, the triangle
inequality bounds every member v: |q - v| >= gap = max(0, |q - p| - hi, lo - |q - p|), hence
<q, v> = (|q|^2 + |v|^2 - |q - v|^2) / 2 <= (|q|^2 + m^2 - gap^2) / 2, and by Cauchy-Schwarz <q, v> <= <q, p> + |q| hi.
Neighbouring rings make a group of about GROUP_ROWS vectors. A query first expands the groups of largest bound
until they hold enough vectors; its k-th best score then stops the search: of the other groups it reads only those
whose bound reaches it, and in them only the rings whose bound does.

Pivots are fitted on a bounded sample (SAMPLE_ROWS), their number grows with the root of the table's rows; every
vector is indexed and none is dropped, so results are exact whatever the pivots are. A ring of many vectors is cut
into cells by the vector's id, queries into blocks of about BLOCK_QUERIES; vectors go to the blocks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import stored, table

RINGS, SAMPLE_ROWS, GROUP_ROWS, BLOCK_QUERIES, SCALE = 8, 8_192, 2_048, 2_048, 1024.0
#: Pivots: twice the root of the rows, within these.
LEAST_PIVOTS, MOST_PIVOTS, PLANNED = 16, 2_048, 256
#: A query's candidates are merged in so many parts first.
MERGES = 16
EXACT = float(1 << 53)
#: No score.
NONE = np.iinfo(np.int64).min


def integers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; null vectors, ones with null or non-finite components and rows without an id are left out."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(good).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 where every partial sum is exact, else in Python integers."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    return (as_int(q) @ as_int(v).T).astype(np.int64)


def fit_pivots(sample: np.ndarray, rows: int, seed: int = 3) -> np.ndarray:
    """Lloyd's means of the sample, from distinct starts; as many as the table's rows ask for."""
    distinct = np.unique(sample, axis=0)
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * rows**0.5)))
    pivots = distinct[np.random.default_rng(seed).permutation(len(distinct))[:wanted]]
    for _ in range(4):
        near = distances(sample, pivots).argmin(1)
        count = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], pivots)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


@dataclass
class Rings:
    """The bounded table of rings of one dimension, by group: at most MOST_PIVOTS * RINGS rows."""

    pivots: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        self.pivot = self.ring // RINGS
        #: The first ring of each group: as many neighbours as hold about GROUP_ROWS vectors.
        before = np.cumsum(self.rows) - self.rows
        self.first = np.flatnonzero(np.diff(before // GROUP_ROWS, prepend=-1))
        self.group = np.searchsorted(self.first, np.arange(len(self.ring)), "right") - 1
        self.group_rows = np.add.reduceat(self.rows, self.first)

    def bounds(self, q: np.ndarray, among: np.ndarray | slice = slice(None)) -> np.ndarray:
        """An upper bound of the inner product for each query and ring (of those at `among`), with room for rounding."""
        pivot, norm = self.pivot[among], self.norm[among]
        d, n = distances(q, self.pivots)[:, pivot], np.linalg.norm(q, axis=1)[:, None]
        gap = np.maximum(0, np.maximum(d - self.high[among], self.low[among] - d))
        by_triangle = (n * n + norm**2 - gap * gap) / 2
        by_pivot = (q @ self.pivots.T)[:, pivot] + n * self.high[among]
        top = np.minimum(by_triangle, by_pivot)
        return top + 1e-6 * (np.abs(top) + n * n + norm**2 + 1)

    def reads(self, q: np.ndarray, kth: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, group) pairs: each query's groups of largest bound that hold 2 k vectors; with k-th scores (-inf where there is none), the other groups that may reach them."""
        top = np.maximum.reduceat(self.bounds(q), self.first, axis=1)
        order = np.argsort(-top, axis=1, kind="stable")
        before = np.cumsum(self.group_rows[order], 1) - self.group_rows[order]
        early = np.zeros(top.shape, bool)
        np.put_along_axis(early, order, before < 2 * k + 1, 1)
        return np.nonzero(early if kth is None else ~early & (top >= kth[:, None]))


def index(vectors: DataFrame, pivots: dict[int, np.ndarray], widths: dict[int, float]) -> DataFrame:
    """(vec_id, v, dim, ring, far, norm): each vector's nearest pivot and ring of distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pivots:
                part = of_dim(batch, dim)
                if not part.num_rows:
                    continue
                x = matrix(part.column(1).combine_chunks()) if dim else np.zeros((part.num_rows, 0))
                d = distances(x, pivots[dim])
                near = d.argmin(1)
                far = d[np.arange(len(x)), near]
                ring = near * RINGS + np.minimum(far // widths[dim], RINGS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), part.column(1).combine_chunks(), pa.array(np.full(len(x), dim), pa.int32()), pa.array(ring, pa.int32()), pa.array(far), pa.array(np.linalg.norm(x, axis=1))], names=["vec_id", "v", "dim", "ring", "far", "norm"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, dim int, ring int, far double, norm double")


def of_dim(batch: pa.RecordBatch, dim: int) -> pa.Table:
    """The rows of a batch whose vectors (its second column) have `dim` components."""
    return pa.Table.from_batches([batch]).filter(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dim)).combine_chunks()


def plan(queries: DataFrame, rings: dict[int, Rings], k: int) -> DataFrame:
    """(query_id, q, kth, dim, part): the groups that each query (query_id, q, kth) reads next; kth is null before the first reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, r in rings.items():
                asked = of_dim(batch, dim)
                for x in range(0, asked.num_rows, PLANNED):
                    part = asked.slice(x, PLANNED).combine_chunks()
                    q = matrix(part.column(1).combine_chunks()) if dim else np.zeros((part.num_rows, 0))
                    kth = part.column(2).to_numpy().astype(float)
                    who, group = r.reads(q, None if np.isnan(kth).all() else kth, k)
                    if len(who):
                        at = pa.array(who)
                        yield pa.RecordBatch.from_arrays([*[c.take(at).combine_chunks() for c in part.columns[:3]], pa.array(np.full(len(who), dim), pa.int32()), pa.array(group, pa.int32())], names=["query_id", "q", "kth", "dim", "part"])

    return queries.mapInArrow(run, "query_id long, q array<double>, kth double, dim int, part int")


def scan(reads: DataFrame, indexed: DataFrame, rings: dict[int, Rings], cells: DataFrame, blocks: int, k: int) -> DataFrame:
    """The k best of every query in every cell that it reads: blocks of queries against cells of vectors, one at a time. cells (dim, ring, part, cut) is a bounded table."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    cut = F.broadcast(cells.groupBy("dim", "part").agg(F.max("cut").alias("cut")))
    asked = reads.withColumn("block", block).join(cut, ["dim", "part"])
    spread = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select("dim", "part", "cell", "block", "query_id", "q", "kth")
    wanted = asked.select("dim", "part", F.col("block").alias("by")).distinct()  # at most groups times blocks
    placed = indexed.join(F.broadcast(cells), ["dim", "ring"]).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.col("cut")).cast("int"))
    held = placed.join(wanted, ["dim", "part"]).select("dim", "part", "cell", F.col("by").alias("block"), "vec_id", "v", "ring")

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), np.int64)]
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by([("ring", "ascending"), ("vec_id", "ascending")])
            r = rings[dim := queries["dim"][0].as_py()]
            ids, ring, names = (t.to_numpy() for t in (vectors["vec_id"], vectors["ring"], queries["query_id"]))
            v, q = (matrix(t[c].combine_chunks()) if dim else np.zeros((t.num_rows, 0)) for t, c in ((vectors, "v"), (queries, "q")))
            kth = np.nan_to_num(queries["kth"].to_numpy().astype(float), nan=-np.inf)
            first = np.flatnonzero(np.diff(ring, prepend=-1))
            ends = np.append(first[1:], len(ring))
            near = r.bounds(q, np.searchsorted(r.ring, ring[first])) >= kth[:, None]
            scores = np.full((len(q), len(v)), NONE)
            for j, (x, y) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
                if len(rows := np.flatnonzero(near[:, j])):
                    scores[rows, x:y] = products(q[rows], v[x:y])
            scores[names[:, None] == ids] = NONE
            least = np.partition(scores, len(v) - k, 1)[:, len(v) - k] if len(v) > k else np.full(len(q), NONE)
            for name, row, low in zip(names.tolist(), scores, least.tolist(), strict=True):
                at = np.flatnonzero((row >= low) & (row > NONE))
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                found.append(np.stack([np.full(len(at), name), ids[at], row[at]]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, np.concatenate(found, 1)), strict=True)))

    keys = ["dim", "part", "cell", "block"]
    return spread.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, top): each query's k best by score, ties to the smaller vec_id, in rank order; merged in parts first, so no array gathers all cells' candidates."""
    one = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    part = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(MERGES)).alias("m")).agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("top"))
    return part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among the vectors, but for the query's own id.

    vectors and queries have (vec_id, v) as from integers(). Only vectors of a query's dimension compete. Ties go
    to the smaller vec_id; a repeated vec_id competes as often as it occurs. Fewer than k are returned where there are fewer.
    """
    rows = {r[0]: r[1] for r in vectors.groupBy(F.size("v").alias("d")).count().collect()}
    pivots, widths = {}, {}
    for dim, n in rows.items():
        sample = vectors.where(F.size("v") == dim).select(F.xxhash64("vec_id").alias("h"), "v").orderBy("h").limit(SAMPLE_ROWS).collect()
        x = np.array([r.v for r in sample], float).reshape(len(sample), dim)
        pivots[dim] = fit_pivots(x, n)
        widths[dim] = max(1.0, float(distances(x, pivots[dim]).min(1).max()) / (RINGS - 1))
    indexed = stored(index(vectors, pivots, widths))
    spark = vectors.sparkSession
    found = indexed.groupBy("dim", "ring").agg(F.count("*").alias("rows"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("norm").alias("norm")).toPandas().sort_values(["dim", "ring"])
    rings = {int(dim): Rings(pivots[int(dim)], *(part[c].to_numpy() for c in ("ring", "low", "high", "norm", "rows"))) for dim, part in found.groupby("dim")}
    places = [(dim, int(ring), int(g), max(1, -(-int(r.group_rows[g]) // (2 * GROUP_ROWS)))) for dim, r in rings.items() for ring, g in zip(r.ring, r.group, strict=True)]
    cells = spark.createDataFrame(places, "dim int, ring int, part int, cut int")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(None).cast("double").alias("kth"))
    blocks = max(1, asked.count() // BLOCK_QUERIES)
    first = stored(best_of(scan(plan(asked, rings, k), indexed, rings, cells, blocks, k), k))
    # a query that has found fewer than k has no bound yet
    known = asked.drop("kth").join(first, "query_id", "left").select("query_id", "q", F.when(F.size("top") >= k, -F.element_at("top", k)["s"].cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    rest = scan(plan(known, rings, k), indexed, rings, cells, blocks, k)
    every = first.select("query_id", F.explode("top").alias("t")).select("query_id", F.col("t.v").alias("vec_id"), (-F.col("t.s")).alias("score")).unionByName(rest)
    ranked = best_of(every, k).select("query_id", F.posexplode("top").alias("i", "t"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), F.col("t.v").alias("vec_id"), (-F.col("t.s")).alias("score"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector of `embeddings` with all others; see top_k.

    Rows without an id and vectors that are null or hold a null or non-finite component take no part. Ties go to the
    smaller vec_id. Only vectors of the query's own length compete. A repeated vec_id competes as often as it occurs,
    never for itself. Other columns are ignored; an empty table gives no rows.
    """
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
