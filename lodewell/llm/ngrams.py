"""Vectorised hashing of character n-grams inside words, for linear text classifiers."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

from lodewell.llm.pretokenize import L, classes


@cache
def folded() -> np.ndarray:
    """Codepoint to its lower-case letter; 0 for anything but a letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    letters = np.flatnonzero(classes() == L)
    table[letters] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return table


class Words:
    """The words (runs of letters, lower-cased) of a batch of texts, and their n-grams.

    An n-gram lies in one word; a word's ends count as one character on either side, as <word>.
    """

    def __init__(self, texts: list[str]):
        joined = "\n" + "".join(f"{t}\n" for t in texts)
        self.x = folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = self.x > 0
        begins = np.zeros(len(self.x), bool)
        begins[1:] = letter[1:] & ~letter[:-1]
        self.index = np.cumsum(begins, dtype=np.int32) - 1
        self.count = int(self.index[-1]) + 1
        self.letter = letter
        #: The text of each word.
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(ends, np.flatnonzero(begins))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number among the distinct words, and a word of each number."""
        at = np.flatnonzero(self.letter)
        word = self.index[at]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        power = np.multiply.accumulate(np.concatenate([[1], np.full(int(place.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64))
        h = np.add.reduceat(self.x[at].astype(np.uint64) * power[place], first) if len(at) else np.zeros(0, np.uint64)
        _, example, kind = np.unique(h, return_index=True, return_inverse=True)
        return kind, example

    def grams(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(word of each n-gram, its bucket)."""
        x, size = self.x, len(self.x) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n == 1:
            at = np.flatnonzero(self.letter)
        else:
            inside = self.letter[1 : size + 1].copy() if n > 2 else self.letter[:size] | self.letter[1 : size + 1]
            for k in range(2, n - 1):
                inside &= self.letter[k : size + k]
            at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ x[at + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        word = self.index[at + (n > 1)]
        if n == 2:
            word = np.where(self.letter[at], self.index[at], word)
        return word, (h % np.uint32(buckets)).astype(np.int32)
