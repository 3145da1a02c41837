"""Elias-Fano sequences over memory-mapped arrays, with vectorised access and search."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

MAGIC, SPARE = b"LWEF0001", 1
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of a byte.
SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


EACH, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each 64-bit word, which has that many."""
    u = np.uint64
    sums = words - (words >> u(1) & u(0x5555555555555555))
    sums = (sums & u(0x3333333333333333)) + (sums >> u(2) & u(0x3333333333333333))
    sums = (sums + (sums >> u(4)) & u(0x0F0F0F0F0F0F0F0F)) * EACH  # set bits up to the end of each byte
    k = k.astype(np.uint64)
    octet = ((((k * EACH | TOPS) - sums & TOPS) >> u(7)) * EACH >> u(56)) * u(8)  # bytes that end before it
    k -= sums << u(8) >> octet & u(255)
    return octet.astype(np.int64) + SELECT[words >> octet & u(255), k]


def to_words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence of unsigned numbers: the low bits packed, the high bits in unary with the zeros before each word.

    SPARE more high bits than the smallest size asks for keep the searched stretches short, for a bit a value.
    """
    values = values.astype(np.uint64)
    n = len(values)
    span = int(values[-1]) + 1 if n else 1
    width = max(0, (span // max(1, n)).bit_length() - 1 - SPARE)
    low = np.zeros(n * width // 64 + 2, np.uint64)
    if n and width:
        part, bit = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
        at, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        low[at[first]] = np.bitwise_or.reduceat(part << off, first)
        last = np.append(first[1:], n) - 1  # only the last value of a word reaches into the next one
        low[at[last] + 1] |= (part[last] >> np.uint64(1)) >> (np.uint64(63) - off[last])
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = np.zeros((int(high[-1]) if n else 0) + n + 2, np.uint8)
    bits[high + np.arange(n)] = 1
    unary = to_words(bits)
    ones = POPCOUNT[unary.view(np.uint8)].reshape(-1, 8).sum(1)
    zeros = np.concatenate([[0], np.cumsum(64 - ones.astype(np.int64))])[:-1]
    return {"meta": np.array([n, width, int(high[-1]) if n else -1], np.int64), "low": low, "unary": unary, "zeros": zeros}


class Sequence:
    """Reads what encode() made; arrays may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width, self.top = (int(x) for x in parts["meta"])
        self.low_words, self.unary, self.zeros = parts["low"], parts["unary"], parts["zeros"]
        self.mask = np.uint64((1 << self.width) - 1)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        at, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        return (self.low_words[at] >> off | (self.low_words[at + 1] << np.uint64(1)) << (np.uint64(63) - off)) & self.mask

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the unary part, from 0."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + select(~self.unary[word], k - self.zeros[word])

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the values with these high bits: the ones between two zeros of the unary part."""
        k = np.maximum(high - 1, 0)
        zero = np.where(high > 0, self.select_zero(k), -1)
        begin = np.where(high > 0, zero - k, 0)
        at = zero + 1
        word, off = at >> 6, (at & 63).astype(np.uint64)
        ahead = self.unary[word] >> off | (self.unary[np.minimum(word + 1, len(self.unary) - 1)] << np.uint64(1)) << (np.uint64(63) - off)
        gap = ~ahead & (ahead + np.uint64(1))  # the lowest zero, 0 if there is none in 64 bits
        run = np.log2(np.maximum(gap, np.uint64(1)).astype(np.float64)).astype(np.int64)
        end = begin + run
        if (full := np.flatnonzero(gap == 0)).size:
            end[full] = self.select_zero(high[full]) - high[full]
        return begin, end

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x, whether it equals x)."""
        x = x.astype(np.uint64)
        at, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        live = np.flatnonzero(high <= self.top)
        if not len(live):
            return at, equal
        low, (a, b) = x[live] & self.mask, self.bucket(high[live])
        at[live] = b
        while True:
            go = a < b
            live, low, a, b = live[go], low[go], a[go], b[go]
            if not len(live):
                return at, equal
            mid = (a + b) >> 1
            value = self.low(mid)
            right = value < low
            at[live[~right]] = mid[~right]
            equal[live[~right]] = value[~right] == low[~right]
            a, b = np.where(right, mid + 1, a), np.where(right, b, mid)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at i: the high bits by a search for the i-th one."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        place = word * 64 + select(self.unary[word], i - ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self.low(i)


def write_arrays(fs: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray]) -> int:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with fs.open_output_stream(path) as f:
        f.write(MAGIC + len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    return 16 + len(text) + at


def read_arrays(fs: pafs.FileSystem, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped on a mounted file system, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        buffer = pa.memory_map(path).read_buffer()
    else:
        with fs.open_input_file(path) as f:
            buffer = f.read_buffer()
    if bytes(buffer[:8]) != MAGIC:
        raise ValueError(f"{path}: not a file of arrays")
    size = int.from_bytes(bytes(buffer[8:16]), "little")
    head = json.loads(bytes(buffer[16 : 16 + size]))
    return {name: np.frombuffer(buffer, kind, n, 16 + size + at) for name, (kind, at, n) in head.items()}
