"""Places whose keys occur more than once in a corpus, found by a packed shuffle.

A place is a position in a document, a key one or two 64-bit hashes. Tasks pack places into arrays by bucket of
key, so a shuffled place costs its key and about two bytes. Before the shuffle each run of RUN places is
aggregated by key: places that share a key already are known to repeat and only one of them is sent to the
key's bucket. What repeats goes home packed as well, to one row for each document. A key that a third of all documents hold thus reaches its bucket once for each run, not once for
each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodewell.llm.common import binary, mix64

RUN, BUCKET_PLACES = 1 << 21, 1 << 21
#: Buckets that a task packs for directly, at most. More of them are reached in two steps, so that packed rows stay large however many tasks and buckets there are.
LEVEL = 1_024
KNOWN, ASKED = 0, 1
#: Places of one document: first its two keys, then the positions and the keys found there.
Places = Iterator[tuple[int, int, np.ndarray, np.ndarray]]


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (a.nbytes, ord(a.dtype.char))]], "<i8").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for size, kind in head:
        a = np.frombuffer(raw, chr(kind), size // np.dtype(chr(kind)).itemsize, at)
        out.append(a)
        at += size
    return out


@dataclass(frozen=True)
class Format:
    """How packed arrays of a kind become columns of entries and back, and the bucket of each entry."""

    open: Callable[[int, list[np.ndarray]], list[np.ndarray]]
    close: Callable[[int, list[np.ndarray]], list[np.ndarray]]
    bucket: Callable[[int, list[np.ndarray]], np.ndarray]


def width(buckets: int) -> int:
    """Neighbouring buckets that a sender packs as one."""
    return -(-buckets // LEVEL)


def dealt(sent: DataFrame, buckets: int, form: Format) -> DataFrame:
    """Rows (bucket, kind, packed), packed by bucket // width(buckets), by buckets: in one shuffle, or in two where the width is not 1. Between them a task packs runs of RUN entries anew."""
    step = width(buckets)
    if step == 1:
        return sent.repartitionById(buckets, "bucket")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size: dict[int, int] = {}

        def flush(kind: int) -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held.pop(kind), strict=True)]
            size.pop(kind)
            bucket = form.bucket(kind, columns)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            rows = [(int(bucket[order[x]]), pack(form.close(kind, [c[order[x:y]] for c in columns]))) for x, y in zip(edges, [*edges[1:], len(order)][: len(edges)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), binary([r[1] for r in rows])], names=["bucket", "kind", "packed"])

        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                columns = form.open(kind, unpack(blob))
                held.setdefault(kind, []).append(columns)
                size[kind] = size.get(kind, 0) + len(columns[0])
                if size[kind] >= RUN:
                    yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    near = sent.repartitionById(-(-buckets // step), "bucket").mapInArrow(again, "bucket int, kind int, packed binary")
    return near.repartitionById(buckets, "bucket")


def same_as_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, whether each in that order has the key of the one before)."""
    order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    s = keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = (s[1:] == s[:-1]).all(1)
    return order, same


def by_document(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, places of each, positions), by document and position."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[first], np.diff(np.append(first, len(doc))), pos


def home_of(b: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers a document's places."""
    return ((mix64(b.view(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def meeting(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket where places of equal keys meet."""
    return ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def places_format(buckets: int) -> Format:
    """Places of documents: ids, places of each document, and columns of the places."""

    def opened(kind: int, arrays: list[np.ndarray]) -> list[np.ndarray]:
        a, b, n, *rest = arrays
        return [np.repeat(a, n), np.repeat(b, n), *rest]

    def closed(kind: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        a, b, *rest = columns
        order = np.lexsort((rest[0], b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return [a[first], b[first], np.diff(np.append(first, len(a))).astype(np.int32), *[c[order] for c in rest]]

    return Format(opened, closed, lambda kind, c: home_of(c[1], buckets) if kind == KNOWN else meeting(c[4], buckets))


class Run:
    """Places gathered by one task until they are sent."""

    def __init__(self, buckets: int, step: int = 1):
        self.buckets, self.step, self.size = buckets, step, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.positions, self.keys, self.size = [], [], [], 0

    def add(self, a: int, b: int, pos: np.ndarray, keys: np.ndarray) -> None:
        self.ids.append((a, b))
        self.positions.append(pos.astype(np.int32))
        self.keys.append(keys)
        self.size += len(pos)

    def rows(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        ids = np.array(self.ids, np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(p) for p in self.positions])
        pos, keys = np.concatenate(self.positions), np.concatenate(self.keys)
        order, same = same_as_before(keys)
        again = np.zeros(len(order), bool)
        again[:-1] |= same[1:]
        again |= same
        first = order[~same]
        out: list[tuple[int, int, bytes]] = []
        if again.any():
            known = order[again]
            for bucket, part in self.split(home_of(ids[doc[known], 1], self.buckets), known):
                d, n, p = by_document(doc[part], pos[part])
                out.append((bucket, KNOWN, pack([ids[d, 0], ids[d, 1], n.astype(np.int32), p])))
        alone = np.zeros(len(doc), bool)
        alone[order[~again]] = True
        for bucket, part in self.split(meeting(keys[first, 0], self.buckets), first):
            part = np.sort(part)  # by document and position again: these compress
            d, n = np.unique(doc[part], return_counts=True)
            out.append((bucket, ASKED, pack([ids[d, 0], ids[d, 1], n.astype(np.int32), pos[part], alone[part], *keys[part].T])))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), binary([x[2] for x in out])], names=["bucket", "kind", "packed"])

    def split(self, bucket: np.ndarray, what: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = bucket // self.step
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        at = 0
        for end in ends.tolist():
            yield int(bucket[order[at]]), what[order[at:end]]
            at = end


def homeward(ids: list[np.ndarray], counts: np.ndarray, pos: np.ndarray, buckets: int, step: int = 1) -> pa.RecordBatch:
    """Places of whole documents, packed by the bucket (of `step` neighbours) that gathers a document's places."""
    a, b = ids
    home = home_of(b, buckets) // step
    order = np.argsort(home, kind="stable")
    starts = np.cumsum(counts) - counts
    rows = []
    edges = np.flatnonzero(np.diff(home[order], prepend=-1)).tolist()
    for x, y in zip(edges, [*edges[1:], len(order)][: len(edges)], strict=True):
        docs = order[x:y]
        n = counts[docs]
        at = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append((int(home[docs[0]]), pack([a[docs], b[docs], n.astype(np.int32), pos[at].astype(np.int32)])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([KNOWN] * len(rows), pa.int32()), binary([r[1] for r in rows])], names=["bucket", "kind", "packed"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with all its places."""
    parts = [unpack(blob) for batch in batches for blob in batch.column(2).to_pylist()]
    if not parts:
        return
    a, b, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    a, b = np.repeat(a, n), np.repeat(b, n)
    order = np.lexsort((pos, b, a))
    a, b, pos = a[order], b[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    raw, ends = pos.astype("<i4").tobytes(), [*first[1:].tolist(), len(a)]
    for x in range(0, len(first), 4_096):
        part = first[x : x + 4_096]
        yield pa.RecordBatch.from_arrays([pa.array(a[part], pa.int64()), pa.array(b[part], pa.int64()), binary([raw[4 * s : 4 * e] for s, e in zip(part.tolist(), ends[x : x + 4_096], strict=True)])], names=["__lw_a", "__lw_b", "positions"])


def repeated(rows: DataFrame, places: Callable[[pa.RecordBatch], Places], expected: float) -> DataFrame:
    """(__lw_a, __lw_b, positions): for documents (by two 64-bit ids), packed positions whose key occurs more than once among all places.

    A document comes once, with all its positions. `expected` is about how many places there are; it sets the number of buckets.
    """
    spark = rows.sparkSession
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(expected // BUCKET_PLACES, 1 << 20), 1))
    step, form = width(buckets), places_format(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run(buckets, step)
        for batch in batches:
            for a, b, pos, keys in places(batch):
                if len(pos):
                    run.add(a, b, pos, keys)
                    if run.size >= RUN:
                        yield run.rows()
        if (last := run.rows()) is not None:
            yield last

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = unpack(blob)
                if kind == KNOWN:
                    a, b, n, pos = got
                    yield homeward([a, b], n.astype(np.int64), pos, buckets, step)
                else:
                    a, b, n, *rest = got
                    asked.append([np.repeat(a, n), np.repeat(b, n), *rest])
        if not asked:
            return
        a, b, pos, alone, *keys = (np.concatenate(x) for x in zip(*asked, strict=True))
        asked.clear()
        order, same = same_as_before(np.stack(keys, 1))
        again = np.zeros(len(order), bool)
        again[:-1] |= same[1:]
        again |= same
        found = order[again]
        found = found[alone[found]]
        if len(found):
            found = found[np.lexsort((pos[found], b[found], a[found]))]
            a, b, pos = a[found], b[found], pos[found]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield homeward([a[first], b[first]], np.diff(np.append(first, len(a))), pos, buckets, step)

    sent = rows.mapInArrow(send, "bucket int, kind int, packed binary")
    met = dealt(sent, buckets, form).mapInArrow(meet, "bucket int, kind int, packed binary")
    return dealt(met, buckets, form).mapInArrow(gathered, "__lw_a long, __lw_b long, positions binary")
