"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)


def removed(texts, window):
    """(words, words that are left) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def shingles(text, size):
    w = words(text, lower=True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(ids, texts, size, similar=80):
    """(set sizes, component ids) of rows; null ids are passed over."""
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(ids[i])
    return [len(s) for s in sets], [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(sets))], [find(i) for i in range(len(sets))]


def lm(train, texts, discount=0.75):
    """(tokens, known, base, score) of texts, and the training tokens."""
    seen = [[*words(t, True), None] for t in train]
    c1 = Counter(w for t in seen for w in t)
    c2 = Counter(p for t in seen for p in zip(t, t[1:], strict=False))
    c3 = Counter(p for t in seen for p in zip(t, t[1:], t[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    total2, held2, total3, held3 = Counter(), Counter(), Counter(), Counter()
    for (a, _), k in c2.items():
        total2[a] += k
        held2[a] += k - discount
    for (a, b, _), k in c3.items():
        total3[a, b] += k
        held3[a, b] += k - discount
    out = []
    for text in texts:
        t, base, score = [*words(text, True), None], 0.0, 0.0
        for i, w in enumerate(t):
            p = (c1[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if i and total2[t[i - 1]]:
                a = t[i - 1]
                p = max(c2[a, w] - discount, 0) / total2[a] + (1 - held2[a] / total2[a]) * p
            if i > 1 and held3[t[i - 2], t[i - 1]]:
                a = (t[i - 2], t[i - 1])
                p = max(c3[*a, w] - discount, 0) / total3[a] + (1 - held3[a] / total3[a]) * p
            score += math.log10(p)
        out.append((len(t), sum(c1[w] > 0 for w in t), base, score))
    return out, n


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus if i is not None else 0


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
