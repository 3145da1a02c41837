"""Byte-level pre-tokenisation without a regex.

The split pattern (contractions, optionally space-led runs of letters, digits or other characters, and white
space) is a finite automaton over codepoint classes once each position's class also tells what follows it.
Every character is then a transition function on nine states, and composing functions is associative: rows of
characters are composed in parallel, the rows' functions are combined by a logarithmic scan, and a replay from
each row's entry state marks where slices begin.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

L, N, O, A1, A2, SPACE_END, WHITE_END, WHITE, STOP = range(9)
INIT, IN_L, IN_N, IN_O, IN_WHITE, LED, ONE_LEFT, TWO_LEFT, DONE = range(9)
STATES, ROW = 9, 256
#: Symbols after which the state does not depend on the one before.
RESETS = np.isin(np.arange(9), [SPACE_END, WHITE_END, WHITE, STOP])
#: Ranges of letters and numbers that Unicode 16 adds to the Python database's 15.1; the merge ranks' library has them.
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: A place where a slice begins whatever comes before.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@cache
def classes() -> np.ndarray:
    """Codepoint to L, N, O or WHITE, from the Unicode character database; White_Space lists the separators Z* and a few controls."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LNZ":
            table[cp] = {"L": L, "N": N, "Z": WHITE}[kind[0]]
    for ranges, kind in ((NEW_LETTERS, L), (NEW_NUMBERS, N)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[[*range(9, 14), 0x85]] = WHITE
    return table


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins), both indexed by symbol * STATES + state."""
    to, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[symbol] = inside
        begins[symbol, [inside, LED]] = False
    to[L, ONE_LEFT], to[L, TWO_LEFT] = DONE, ONE_LEFT
    begins[L, [ONE_LEFT, TWO_LEFT]] = False
    for symbol, left in ((A1, ONE_LEFT), (A2, TWO_LEFT)):
        to[symbol] = left
        to[symbol, [IN_O, LED]] = IN_O
        begins[symbol, [IN_O, LED]] = False
    to[SPACE_END], to[WHITE_END], to[WHITE], to[STOP] = LED, IN_WHITE, IN_WHITE, INIT
    begins[WHITE, IN_WHITE] = False
    return to.ravel().astype(np.intp), begins.ravel()


def symbols(cp: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The automaton's input: each codepoint's class refined by what follows; stops are the separators' places, the last at the end."""
    base = classes()[cp]
    base[stops] = WHITE
    out = base.copy()
    white = base == WHITE
    ends = np.zeros(len(cp), bool)
    ends[:-1] = white[:-1] & ~white[1:]
    out[ends] = np.where(cp[ends] == 32, SPACE_END, WHITE_END)
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        after = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = after[quote + 1], after[quote + 2]
        out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = A1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quote[two]] = A2
    out[stops] = STOP
    return out


def slice_starts(sym: np.ndarray) -> np.ndarray:
    """Places where slices begin, by a blocked scan of transition functions.

    Rows of ROW characters are replayed side by side. A row with a resetting symbol (one that leads to the same
    state from any) is a constant function, known from its replay; only the others are composed state by state.
    The scan over rows gives each its entry state, and the characters before its first reset are replayed anew.
    """
    to, begins = automaton()
    n = len(sym)
    rows = -(-n // ROW)
    grid = np.full(rows * ROW, STOP, np.uint8)
    grid[:n] = sym
    by_row = grid.reshape(rows, ROW)
    grid = np.ascontiguousarray(by_row.T).astype(np.intp) * STATES
    marks = np.empty((ROW, rows), bool)
    state = np.full(rows, INIT, np.intp)
    for i, column in enumerate(grid):
        at = column + state
        marks[i], state = begins[at], to[at]
    resets = RESETS[by_row]
    bound = resets.any(1)
    first = np.where(bound, resets.argmax(1) + 1, ROW)
    f = np.repeat(state[:, None], STATES, 1)
    if len(free := np.flatnonzero(~bound)):
        own = np.tile(np.arange(STATES), (len(free), 1))
        for column in grid[:, free]:
            own = to[column[:, None] + own]
        f[free] = own
        step = 1
        while step < rows:  # inclusive scan: f[i] becomes the composition of rows 0..i
            f[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
            step *= 2
    state = np.concatenate([[INIT], f[:-1, INIT]])
    order = np.argsort(-first, kind="stable")
    order = order[state[order] != INIT]
    left = np.searchsorted(-first[order], -np.arange(ROW), "left")
    state = state[order]
    for i in range(ROW):  # rows whose first reset is at column i or later
        if not (k := left[i]):
            break
        at = grid[i, order[:k]] + state[:k]
        marks[i, order[:k]], state = begins[at], to[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def pieces(text: str, limit: int) -> list[str]:
    """The text cut where a slice begins in any case, into pieces of about `limit` code points."""
    if len(text) <= 2 * limit:
        return [text]
    out, at = [], 0
    while len(text) - at > 2 * limit and (m := SAFE.search(text, at + limit)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def places(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by single separators, where slices begin in them, and where the separators are."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    return joined, slice_starts(symbols(cp, stops)), stops


def spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where each text's slices begin and end among all; the separators are slices between them."""
    ends = np.searchsorted(starts, stops)
    return np.stack([np.concatenate([[0], ends[:-1] + 1]), ends], 1)


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All slices of the texts in order; where each text's slices begin and end among them; each slice's code point offset in the texts joined by single separators."""
    joined, starts, stops = places(texts)
    at = starts.tolist()
    slices = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
    return slices, spans(starts, stops), starts


def split_bytes(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All slices of the texts in order, as UTF-8 in one buffer without an object for each; where each text's slices begin and end among them."""
    joined, starts, stops = places(texts)
    data = joined.encode("utf-8", "surrogatepass")
    at = starts if len(data) == len(joined) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), spans(starts, stops)
