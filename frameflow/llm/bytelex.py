"""Vectorised lexing of UTF-8 text: words, pre-tokens and 64-bit hashes of both, without Python strings.

Texts of an Arrow batch are laid out in one byte array with a line feed before, between and after them. Hashes are
multilinear over random odd multipliers from a fixed seed, so they are equal in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Classes of bytes: white space (space, U+0009 to U+000D), letter, digit, mark, and what needs the full tokenizer.
BLANK, LETTER, DIGIT, MARK, OTHER, WHOLE = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x21:0x7F] = MARK
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[0x27, 0x3C]] = OTHER  # an apostrophe may start a contraction, < a special token
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = _CLASS == BLANK
_LONGEST = 1 << 12
_FACTORS = np.random.default_rng(20240607).integers(0, 1 << 63, (3, _LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Some texts as bytes: data with separators, and begin and end of each text in it."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        size = np.diff(offsets)
        if column.null_count:
            size = np.where(np.asarray(column.is_valid()), size, 0)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.begin = np.cumsum(size) - size + np.arange(1, n + 1)
        self.end = self.begin + size
        self.data = np.full(int(size.sum()) + n + 1, 10, np.uint8)
        for a, b, o in zip(self.begin.tolist(), self.end.tolist(), offsets.tolist()):
            self.data[a:b] = raw[o : o + b - a]

    def __len__(self) -> int:
        return len(self.begin)


def spans(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `limit` bytes of text; a longer text comes alone."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to


def parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """The texts of such rows."""
    for at, to in spans(column, limit):
        yield at, to, Texts(column.slice(at, to - at))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit hash of each range of bytes; ranges are in order and don't overlap. Never 0."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
    values = data[place + np.repeat(begin, size)].astype(np.uint64) + np.uint64(1)
    long = place >= _LONGEST
    if long.any():  # beyond the table, its multipliers again, multiplied by a power for each time around
        turn = place // _LONGEST
        values *= _FACTORS[2, turn % _LONGEST]
        place %= _LONGEST
    values *= _FACTORS[kind, place]
    out = mixed(np.add.reduceat(values, ends - size) + size.astype(np.uint64) * _MIX)
    return np.where(out == 0, np.uint64(1), out)


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words `[^\\x20\\x09-\\x0D]+`, in order."""
    edge = np.diff(_SPACE[texts.data].view(np.int8))
    return np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def of_text(texts: Texts, begin: np.ndarray) -> np.ndarray:
    """Bounds, by text, in a list of positions in order: text k has those from the k-th to the k+1-th."""
    return np.concatenate([np.searchsorted(begin, texts.begin), [len(begin)]]) if len(texts) else np.zeros(1, np.int64)


def pretokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and class of each pre-token, and the bytes in lower case that they are to be looked up by.

    Letters (ASCII, Latin-1) and marks form runs, digits stand alone. A word with any other character is one
    pre-token of class WHOLE with its bytes as they are.
    """
    data = texts.data
    kind, low = _CLASS[data], _LOWER[data]
    if (kind == OTHER).any():
        lead = np.flatnonzero(data[:-1] == 0xC3)
        cont = data[lead + 1]
        ok = (cont >= 0x80) & (cont <= 0xBF) & (cont != 0x97) & (cont != 0xB7)
        lead, cont = lead[ok], cont[ok]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(cont < 0x9F, cont + 32, cont)
        if (kind == OTHER).any():
            b, e = words(texts)
            odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
            bad = odd[e] > odd[b]
            b, e = b[bad], e[bad]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[b] += 1
            inside[e] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            kind[inside] = WHOLE
            low[inside] = data[inside]
    new = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(new) + 1
    begin, end = at[:-1], at[1:]
    keep = kind[begin] != BLANK
    begin, end = begin[keep], end[keep]
    return begin, end, kind[begin], low


class Table:
    """Open addressing from 64-bit hashes (not 0) to numbers 0, 1, ... in order of insertion."""

    def __init__(self, bits: int = 14):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers, -1 where absent."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.values[slot], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            hit = got == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are absent get the next numbers."""
        if 2 * (self.n + len(h)) > 1 << self.bits:
            while 2 * (self.n + len(h)) > 1 << self.bits:
                self.bits += 1
            full = self.keys != 0
            keys, values = self.keys[full], self.values[full]
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(keys, values)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            won = self.keys[s] == h[left]
            self.values[s[won]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
