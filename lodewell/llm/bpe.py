"""Byte-level BPE encoding and decoding (operator 9).

`encode` splits texts by the vectorised pre-tokeniser and merges pairs of each slice's bytes by rank, with a
bounded cache of slices. The ids come as little-endian unsigned 32-bit integers together with the code point
offset and id count of every slice, so that any slice decodes alone; `decode` concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.common import BATCH_CHARS, binary, chunks, table
from lodewell.llm.pretokenize import pieces, split

CACHED, CACHED_CHARS, LONG = 500_000, 48, 128
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONG:
        return merge_long(piece, ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    near = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while near and (low := min(near)) != NONE:
        i = near.index(low)
        parts[i] += parts.pop(i + 1)
        del near[i]
        if i < len(near):
            near[i] = get(parts[i] + parts[i + 1], NONE)
        if i:
            near[i - 1] = get(parts[i - 1] + parts[i], NONE)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces in n log n: a heap of pairs over a linked list of parts."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n

    def offer(i: int) -> None:
        if end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class SliceEncoder:
    """Slices to little-endian id bytes, through a bounded cache; `ids_of` encodes what is not cached."""

    def __init__(self, ids_of, dtype: str = "<u4"):
        self.ids_of, self.dtype, self.cache = ids_of, dtype, {}
        self.code = next(c for c in "HIL" if array(c).itemsize == np.dtype(dtype).itemsize)

    def packed(self, word: str) -> bytes:
        ids = array(self.code, self.ids_of(word))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, slices: list[str]) -> list[bytes]:
        out = list(map(self.cache.get, slices))
        if None in out:
            fresh = {w: self.packed(w) for w in {w for w, x in zip(slices, out, strict=True) if x is None}}
            out = [fresh[w] if x is None else x for w, x in zip(slices, out, strict=True)]
            if len(self.cache) > CACHED:
                self.cache.clear()
            self.cache.update(fresh if max(map(len, fresh)) <= CACHED_CHARS else {w: x for w, x in fresh.items() if len(w) <= CACHED_CHARS})
        return out

    def lengths(self, got: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(self.dtype).itemsize

    def texts(self, texts: list[str], offsets: bool) -> Iterator[tuple[bytes, np.ndarray | None, np.ndarray | None]]:
        slices, spans, starts = split(texts)
        got = self(slices)
        origin = 0
        for text, (a, b) in zip(texts, spans.tolist(), strict=True):
            yield b"".join(got[a:b]), starts[a:b] - origin if offsets else None, self.lengths(got[a:b]) if offsets else None
            origin += len(text) + 1

    def all(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[bytes, np.ndarray | None, np.ndarray | None]]:
        """For each text: id bytes and, if asked, its slices' code point offsets and id counts. A long text goes by pieces."""
        run: list[str] = []
        for t in texts:
            if len(t) <= 2 * BATCH_CHARS:
                run.append(t)
                continue
            if run:
                yield from self.texts(run, offsets)
                run = []
            ids, at, counts, origin = [], [], [], 0
            for piece in pieces(t, BATCH_CHARS):
                for x, o, c in self.texts([piece], offsets):
                    ids.append(x)
                    if offsets:
                        at.append(o + origin)
                        counts.append(c)
                origin += len(piece)
            yield b"".join(ids), np.concatenate(at) if offsets else None, np.concatenate(counts) if offsets else None
        if run:
            yield from self.texts(run, offsets)


def encode(docs: DataFrame, rank_path: str, *, decode_too: bool = False, slices: bool = False) -> DataFrame:
    """doc_id and `ids` (binary, little-endian unsigned 32 bits) of every row's whole text.

    With `slices`, also slice_offsets and slice_counts (binary, the same format): code point offset and id count
    of each slice. With `decode_too`, also `decoded`: the bytes that the ids decode to. A null text counts as
    empty and has no ids; repeated rows each give their row; other columns of docs are ignored. Map-only: no shuffle.
    """
    schema = "doc_id long, ids binary" + ", slice_offsets binary, slice_counts binary" * slices + ", decoded binary" * decode_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(rank_path)
        encoder = SliceEncoder(lambda word: merge(word.encode("utf-8", "surrogatepass"), ranks))
        back = id_bytes(ranks)
        for batch in batches:
            ids_of = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist()):
                ids, offsets, counts = [], [], []
                for x, o, c in encoder.all(texts, slices):
                    ids.append(x)
                    if slices:
                        offsets.append(o.astype("<u4").tobytes())
                        counts.append(c.astype("<u4").tobytes())
                columns = [ids_of.slice(first, len(texts)), binary(ids)] + [binary(offsets), binary(counts)] * slices
                if decode_too:
                    columns.append(binary([decode_ids(x, back) for x in ids]))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def id_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


def decode_ids(ids: bytes, back: list[bytes]) -> bytes:
    return b"".join(map(back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id and text of rows that `encode` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = id_bytes(read_ranks(rank_path))
        for batch in batches:
            texts = [decode_ids(x or b"", back).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, rank_path: str) -> DataFrame:
    done = encode(docs, rank_path, decode_too=True)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of `documents`, encoded and decoded; see digests.

    A null text is the empty one: no ids, and the digests of nothing. Repeated rows each have a row. Other columns are
    ignored; an empty table gives no rows.
    """
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
