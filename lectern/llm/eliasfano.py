"""Elias-Fano sequences and an n-gram trie level made of them.

A monotone sequence keeps its low bits packed and its high bits as unary gaps;
access is a select among ones, and successor search starts at a select among
zeros. All operations take arrays. A level's arrays are written to one file and
memory-mapped, so tasks on a machine page in only what queries touch.
"""

from __future__ import annotations

import os

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with select on ones and on zeros."""

    def __init__(self, words: np.ndarray, size: int) -> None:
        self.words, self.size = words, size
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(words) + 1, dtype=np.int64) * 64 - self.ones

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        at = np.searchsorted(before, k, "right") - 1
        word = self.words[at]
        if flip:
            word = ~word
        left = (k - before[at]).astype(np.int64)
        pos = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            pos += np.where(up, width, 0)
            word = np.where(up, word >> U(width), word)
        return at * 64 + pos

    def select1(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one, from 0."""
        return self._select(k, self.ones, False)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero, from 0."""
        return self._select(k, self.zeros, True)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """values of width bits each, in 64-bit words, with a spare word."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.concatenate([[True], word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(values << shift, np.flatnonzero(first))
        over = np.flatnonzero((at & 63) + width > 64)
        out[word[over] + 1] |= values[over] >> (U(64) - shift[over])
    return out


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.width = n, max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> self.width).astype(np.int64)
        size = n + (top >> self.width) + 2
        bits = np.zeros((size // 64 + 1) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.low = _packed(values.astype(np.uint64) & U((1 << self.width) - 1), self.width)
        self.words, self.size, self.top = np.packbits(bits, bitorder="little").view("<u8"), size, top
        self.high = Bits(self.words, size)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        spill = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (((self.low[word] >> shift) | spill) & U((1 << self.width) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self.high.select1(i) - i) << self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, hit): the first place whose value is x or more, and whether it is x."""
        h = np.minimum(x >> self.width, (self.top >> self.width) + 1)
        a = np.where(h > 0, self.high.select0(np.maximum(h - 1, 0)) + 1 - h, 0)
        end = np.minimum(self.high.select0(h) - h, self.n)
        b, low = end.copy(), x & ((1 << self.width) - 1)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        hit[inside] = self._low(a[inside]) == low[inside]
        return a, hit


class Level:
    """Successors of contexts: monotone pointers into one monotone sequence of relative words, and a code each.

    contexts: sorted. Words are stored relative to their context: the last value of
    the previous range is added, so the whole level is one increasing sequence.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray) -> None:
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.contexts = EliasFano(context[head])
        self.pointers = EliasFano(np.append(head, len(context)))
        tail = word[np.append(head[1:], len(context)) - 1] + 1 if len(head) else head
        base = np.cumsum(tail) - tail
        self.words = EliasFano(word + np.repeat(base, np.diff(np.append(head, len(context)))))
        self.codes = code

    def save(self, path: str) -> None:
        """Write the arrays to one file and map them back from it."""
        parts = [x for s in (self.contexts, self.pointers, self.words) for x in (s.low, s.words)]
        with open(path, "wb") as out:
            for x in parts:
                out.write(x.tobytes())
            out.write(self.codes.tobytes())
        whole = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        at = 0
        for s in (self.contexts, self.pointers, self.words):
            for name in ("low", "words"):
                size = getattr(s, name).nbytes
                setattr(s, name, whole[at : at + size].view("<u8"))
                at += size
            s.high.words = s.words
        self.codes = whole[at:]

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, base) of each context's successors; empty ones are (0, 0, 0)."""
        first, end, base = (np.zeros(len(context), np.int64) for _ in range(3))
        if self.contexts.n:
            at, hit = self.contexts.successor(context)
            ok = np.flatnonzero(hit)
            first[ok], end[ok] = self.pointers.access(at[ok]), self.pointers.access(at[ok] + 1)
            later = ok[first[ok] > 0]
            base[later] = self.words.access(first[later] - 1) + 1
        return first, end, base

    def place(self, first: np.ndarray, end: np.ndarray, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where each word stands after its context's range begins, -1 where it never followed."""
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero(end > first)
        if len(some):
            at, hit = self.words.successor(base[some] + word[some])
            ok = hit & (at >= first[some]) & (at < end[some])
            out[some[ok]] = at[ok]
        return out

    def find(self, first: np.ndarray, end: np.ndarray, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word after its context's range, 0 where it never followed."""
        at = self.place(first, end, base, word)
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], 0) if len(self.codes) else np.zeros(len(word), np.uint8)
