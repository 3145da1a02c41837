"""Token-ID files (operator 4): serialised id arrays under a shared zstandard dictionary.

A store is a folder of shards in ascending doc_id order, a dictionary and a manifest. A shard holds one
zstandard frame for each document, then an index:

    magic "LWTOK1" | id width (1 byte) | sha256 of the dictionary | frames ...
    | doc ids (int64) | null flags (uint8) | frame offsets (uint64, one more than frames) | token counts (uint64) | documents (uint64) | index offset (uint64)

so a short document is read by one seek and one small decompression. Files are written under a temporary name
and moved, so a task that runs again replaces its own shard by the same bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.bpe import SliceEncoder
from lodewell.llm.common import binary, chunks, open_fs, shared_dir, table
from lodewell.llm.pretokenize import split_bytes

MAGIC = b"LWTOK1"
#: The dictionary is trained on about so many documents, by the hash of their ids, and on so many code points of each, from a hashed place; it never changes what is stored.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 600, 8_000, 64 << 10, 3
#: Documents a shard, about; shards at most.
SHARD_DOCS, MOST_SHARDS = 20_000, 20_000
#: Code points whose distinct slices are numbered at once, and how many of these are looked up at once.
RUN_CHARS, SOME = 8 << 20, 100_000


@lru_cache(2)
def model(path: str):
    """The tokenizers library's BPE model of a tokenizer file, and the byte alphabet that its pre-tokenizer would apply."""
    from tokenizers import models

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0), alphabet, "<u2" if max([*spec["vocab"].values(), *added(path)[1].values()]) < 1 << 16 else "<u4"


@lru_cache(2)
def added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern of the tokenizer file's added tokens, which the library cuts out of a text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = [t for t in spec.get("added_tokens") or [] if t["content"]]
    if spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{path}: normalizers and added tokens that look at their neighbours are not supported")
    longest = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if tokens else None, {t["content"]: t["id"] for t in tokens}


def unpacked(a: pa.LargeBinaryArray) -> tuple[np.ndarray, bytes]:
    """A whole array's offsets and bytes."""
    return np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset), (a.buffers()[2] or pa.py_buffer(b"")).to_pybytes()


class TokenEncoder(SliceEncoder):
    """Whole texts as the tokenizers library encodes them: the texts between added tokens by slices, added tokens as their own ids.

    Slices are UTF-8 bytes here. Arrow numbers the distinct ones of a run, only those become Python objects, and the
    texts' ids are taken by number.
    """

    def __init__(self, ids_of, dtype: str, path: str):
        super().__init__(ids_of, dtype)
        self.pattern, ids = added(path)
        self.own = {t: np.array([i], dtype).tobytes() for t, i in ids.items()}

    def texts(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[bytes, None, None]]:
        if offsets:
            raise ValueError("a store has no slice offsets")
        runs = [split_bytes(t) for _, t in chunks(texts)]
        coded = pa.chunked_array([slices for slices, _ in runs]).dictionary_encode()  # one dictionary for all chunks
        at, raw = unpacked(coded.chunk(0).dictionary)
        some = (at[i : i + SOME + 1].tolist() for i in range(0, len(at) - 1, SOME))
        ids = pa.concat_arrays([pa.array(self([raw[a:b] for a, b in pairwise(x)]), pa.large_binary()) for x in some])
        for (_, spans), run in zip(runs, coded.chunks, strict=True):
            at, raw = unpacked(ids.take(run.indices))
            for a, b in at[spans].tolist():
                yield raw[a:b], None, None

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """Id bytes of each text."""
        if self.pattern is None or not any(t in x for x in texts for t in self.own):
            yield from (ids for ids, _, _ in self.all(texts))
            return
        parts = [self.pattern.split(x) for x in texts]  # an added token at each odd place
        between = (ids for ids, _, _ in self.all([p for x in parts for p in x[::2]]))
        for x in parts:
            yield b"".join(self.own[p] if i % 2 else next(between) for i, p in enumerate(x))


def encoder(path: str) -> TokenEncoder:
    """Slices by the pre-tokeniser, their ids from the tokenizers library."""
    bpe, alphabet, dtype = model(path)
    tokenize = bpe.tokenize

    def ids_of(word: bytes) -> list[int]:
        return [t.id for t in tokenize(word.decode("latin-1").translate(alphabet))]

    return TokenEncoder(ids_of, dtype, path)


@lru_cache(1)
def kept_encoder(path: str) -> TokenEncoder:
    """A worker's own encoder, whose slices stay known from task to task."""
    return encoder(path)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; of too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples)[-DICT_BYTES:] + bytes(8))[: DICT_BYTES + 8]


def shard_of(docs: DataFrame, shards: int) -> list[int]:
    """Ids that divide the rows into about equal shards: a bounded summary of quantiles, exact in the id's type."""
    if shards < 2:
        return []
    at = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * shards))).first()[0] or []
    return sorted(set(found))


def write_store(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0) -> list[dict]:
    """Write the store of every row's whole text to the shared path `out`; returns the manifest, a record for each shard.

    A null text is empty, and every document's ids end with end_id. Null doc_ids come first; repeated doc_ids
    each keep their document, in the order of their bytes. One narrow pass counts and finds the shards' bounds;
    texts are encoded where they are read, and only compressed frames are shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(shard_of(docs, max(1, min(MOST_SHARDS, max(partitions, n // SHARD_DOCS), n // 16))), np.int64)
    dtype = model(tokenizer_path)[2]
    end = np.array([end_id], dtype).tobytes()

    unit = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # of longer texts a stretch from a hashed place
    place = (F.pmod(F.xxhash64("doc_id", F.lit(44)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)).cast("long") + 1) + 1).cast("int")
    sample = docs.where((F.col("text") != "") & (unit < min(1.0, SAMPLE_DOCS / max(1, n)))).select(F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text"))
    trained = list(encoder(tokenizer_path).whole(sorted(r.text for r in sample.collect())))
    dictionary = train_dictionary(trained)
    digest = hashlib.sha256(dictionary).digest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = kept_encoder(tokenizer_path), zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        width = np.dtype(dtype).itemsize
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in chunks(batch.column(1).to_pylist(), RUN_CHARS):
                here = doc_ids.slice(first, len(texts))
                raw = [ids + end for ids in encode.whole(texts)]
                shard = np.searchsorted(bounds, here.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), here, pa.array([len(x) // width for x in raw], pa.int64()), binary([pack.compress(x) for x in raw])], names=["shard", "doc_id", "n_tokens", "frame"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []
        for batch in batches:
            for shard, doc_id, n_tokens, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if writer is None or writer.shard != shard:
                    if writer:
                        made.append(writer.close())
                    writer = ShardWriter(out, shard, dtype, digest)
                writer.add(doc_id, n_tokens, frame)
        if writer:
            made.append(writer.close())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    frames = docs.mapInArrow(encoded, "shard int, doc_id long, n_tokens long, frame binary")
    ordered = frames.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(written, "shard long, path string, documents long, tokens long").collect()), key=lambda r: r["shard"])
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["tokens"]
    fs, base = open_fs(out)
    fs.create_dir(base, recursive=True)
    for name, data in (("dictionary", dictionary), ("manifest.json", json.dumps({"id_type": dtype, "dictionary_sha256": digest.hex(), "shards": manifest}).encode())):
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(data)
    return manifest


class ShardWriter:
    """One shard; the frames are streamed, only the index is kept in memory."""

    def __init__(self, out: str, shard: int, dtype: str, digest: bytes):
        self.shard, self.path = shard, f"shard-{shard:06d}.lwtok"
        self.fs, self.base = open_fs(out)
        self.fs.create_dir(self.base, recursive=True)
        self.part = f"{self.base}/{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.part)
        self.ids, self.counts = [], []
        head = MAGIC + bytes([np.dtype(dtype).itemsize]) + digest
        self.file.write(head)
        self.at = [len(head)]

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.file.write(frame)
        self.ids.append(doc_id)
        self.counts.append(n_tokens)
        self.at.append(self.at[-1] + len(frame))

    def close(self) -> dict:
        null = np.array([i is None for i in self.ids], np.uint8)
        for a in (np.array([i or 0 for i in self.ids], "<i8"), null, np.array(self.at, "<u8"), np.array(self.counts, "<u8"), np.array([len(self.ids), self.at[-1]], "<u8")):
            self.file.write(a.tobytes())
        self.file.close()
        self.fs.move(self.part, f"{self.base}/{self.path}")
        return {"shard": self.shard, "path": self.path, "documents": len(self.ids), "tokens": sum(self.counts)}


class Shard:
    """Random access to a shard's documents; the dictionary must be the one that the shard was written with."""

    def __init__(self, out: str, path: str, dictionary: bytes):
        fs, base = open_fs(out)
        self.file = fs.open_input_file(f"{base}/{path}")
        head = self.file.read(len(MAGIC) + 33)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: not a token shard of this dictionary")
        self.dtype = f"<u{head[len(MAGIC)]}"
        size = self.file.size()
        n, index = np.frombuffer(self.read(size - 16, 16), "<u8").tolist()
        raw = self.read(index, size - 16 - index)
        self.doc_ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.nulls = null.astype(bool)
        self.at = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u8", n, 9 * n + 8 * (n + 1)).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """The i-th document's ids, by one read of its frame."""
        return np.frombuffer(self.unpack.decompress(self.read(int(self.at[i]), int(self.at[i + 1] - self.at[i]))), self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        a, b = (int(np.searchsorted(self.doc_ids, doc_id, side)) for side in ("left", "right"))
        return [self.ids(i) for i in range(a, b) if not self.nulls[i]]


def read_store(spark: SparkSession, out: str, manifest: list[dict], *, with_ids: bool = False) -> DataFrame:
    """Every document of the store's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids as a binary of unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(out)
        with fs.open_input_stream(f"{base}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(out, path, dictionary)
                starts = start + np.concatenate([[0], np.cumsum(shard.counts)[:-1]]).astype(np.int64)
                for a in range(0, len(shard), 2_000):
                    b = min(len(shard), a + 2_000)
                    ids = [shard.ids(i).astype("<u4").tobytes() for i in range(a, b)]
                    if any(len(x) != 4 * n for x, n in zip(ids, shard.counts[a:b].tolist(), strict=True)):
                        raise ValueError(f"{path}: a frame does not have the ids that the index says")
                    columns = [pa.array(shard.doc_ids[a:b], pa.int64(), mask=shard.nulls[a:b]), pa.array(starts[a:b]), pa.array(shard.counts[a:b]), pa.array([zlib.crc32(x) for x in ids], pa.int64())] + [binary(ids)] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    rows = [(r["path"], r["start"]) for r in manifest]
    return spark.createDataFrame(rows, "path string, start long").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every text of `documents`, each document's end id 0 with them, to a store, and reads it back; see write_store and read_store.

    A null text is the empty one: its end alone. Documents lie in ascending doc_id order, null ids first, equal ids by
    their frames. Repeated rows each have a frame. Other columns are ignored; an empty table gives no rows.
    """
    out = shared_dir(spark)
    manifest = write_store(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_store(spark, out, manifest)
