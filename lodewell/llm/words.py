"""Vectorised hashes of words and of windows of words, over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

from lodewell.llm.common import mix64

#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The six ASCII white-space bytes.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; tables up to 4M entries are kept."""
    known = _powers.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    size = n if n > 1 << 22 else min(1 << 22, max(1 << 12, 1 << (n - 1).bit_length()))
    x = np.full(size, base, np.uint64)
    x[0] = 1
    x = np.multiply.accumulate(x)
    if size <= 1 << 22:
        _powers[base] = x
    return x[:n]


@cache
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@cache
def letters(base: int, lower: bool) -> np.ndarray:
    """A random number for each byte, 0 for white space; A-Z share those of a-z if `lower`."""
    out = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    if lower:
        out[65:91] = out[97:123]
    out[SPACE] = 0
    return out


class WordHashes:
    """Hashes of every word of some texts (runs of anything but ASCII white space), and of any window of them.

    A word's hash sums its bytes' numbers times powers of an odd base; a window's hash does the same over words.
    """

    def __init__(self, texts: list[str] | list[bytes], lower: bool = False, hashes: int = 2, windows: bool = True):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        space = SPACE[data]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        ends = np.cumsum([len(t) + 1 for t in raw])
        at = np.searchsorted(starts, ends)
        #: First word of each text, and the end of the last.
        self.bounds = np.concatenate([[0], at]).astype(np.int64)
        self.words, self.sums, self.back = [], [], []
        if not len(starts):
            return
        for base in BASES[:hashes]:
            sums = np.add.reduceat(letters(base, lower)[data] * powers(base, len(data)), starts)
            words = mix64(sums * powers(inverse(base), len(data))[starts])
            self.words.append(words)
            if not windows:
                continue
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(words * powers(base, len(words)), dtype=np.uint64)]))
            self.back.append(powers(inverse(base), len(words)))

    def windows(self, at: np.ndarray, size: int, hashes: int = 2) -> np.ndarray:
        """Hashes of the windows of `size` words that start at the words `at`."""
        return np.stack([mix64((s[at + size] - s[at]) * b[at]) for s, b in zip(self.sums[:hashes], self.back, strict=False)], 1)
