"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.llm.common import drop, stored

#: Edges that a task holds at once.
RUN_EDGES = 1 << 20


def forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(root, node) for every node of the edges but the roots: the smallest node of its component among these edges."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names)
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    ends = place[both.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(names))
    while True:  # labels take the smaller end's, then jump to their label's label
        a, b = label[ends[0]], label[ends[1]]
        if (a == b).all():
            break
        ends = ends[:, a != b]
        a, b = np.minimum(a[a != b], b[a != b]), np.maximum(a[a != b], b[a != b])
        np.minimum.at(label, b, a)
        while not np.array_equal(further := label[label], label):
            label = further
    child = np.flatnonzero(label != np.arange(len(label)))
    return names.take(order.take(pa.array(label[child]))), names.take(order.take(pa.array(child)))


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): spanning forests, as stars, of each task's runs of edges."""
    most = RUN_EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            roots, nodes = forest(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([roots, nodes], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.mapInArrow(run, "u string, v string")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v): the smallest node of its component. An edge from a node to itself counts for nothing.

    Tasks contract runs of edges to forests, in ever fewer tasks, until one run holds all that is left; where
    contracting gets no further, the labels spread in rounds instead. Every step is written to the shared folder.
    """
    count = edges.count()
    while True:
        last = count < RUN_EDGES
        part = edges.coalesce(1) if last else edges
        new = stored(contracted(part))
        drop(edges)
        edges = new
        if last:
            label = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
            return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
        was, count = count, edges.count()
        if count > 0.7 * was:
            return spread(edges)
        if count >= RUN_EDGES:  # neighbours meet in a task before the next contraction
            edges = edges.repartition(-(-count // (RUN_EDGES // 2)), "u")


def spread(edges: DataFrame) -> DataFrame:
    """The same by rounds: labels take the neighbours' minimum and then jump to their label's label, until nothing changes. A node of many edges is joined to one label row, so its edges can be split."""
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        step = stored(step)
        jump = step.select(F.col("node").alias("at"), F.col("now").alias("further"))
        new = stored(step.join(jump, step["now"] == jump["at"]).select("node", "was", F.least("now", "further").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        drop(labels, step)
        labels = new
        if not changed:
            drop(both, edges)
            return labels.select("node", "label")
