"""A compressed full-text index over sequences of words.

The Burrows-Wheeler transform of all pieces (each closed by a terminator that
sorts below every word) is stored in a wavelet matrix: one bit vector per bit of
the alphabet, with popcount ranks. Backward search narrows the interval of
suffixes that start with a pattern by one word a step; here many patterns step
together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with a running count, so rank is one lookup and one popcount."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        k = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & low)


class WaveletMatrix:
    """rank of any symbol at any position of a sequence."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels: list[BitVector] = []
        self.bits = bits
        for b in reversed(range(bits)):
            bit = ((sequence >> b) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def start(self, symbols: np.ndarray) -> np.ndarray:
        """Where each symbol's run begins in the last level's order: rank's origin."""
        at = np.zeros(len(symbols), np.int64)
        return self._down(symbols, at)

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, b in zip(self.levels, reversed(range(self.bits)), strict=True):
            ones = level.rank(i)
            i = np.where((symbols >> b) & 1 == 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """How often symbols[k] stands before position i[k]; origin: start(symbols)."""
        return self._down(symbols, i) - origin


def suffix_ranks(sequence: np.ndarray, piece: np.ndarray, keep: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rank of every suffix, and the classes by the first k symbols for the k of keep (powers of two).

    Symbol 0 ends a piece; ends are told apart by their piece, so ranks differ.
    """
    n = len(sequence)
    rank = np.where(sequence == 0, piece, sequence + (int(piece[-1]) + 1 if n else 0)).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    kept, k = {1: rank} if 1 in keep else {}, 1
    while n and (int(rank.max()) + 1 < n or k < max(keep, default=0)):
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        k *= 2
        if k in keep:
            kept[k] = rank
    return rank, kept


class FMIndex:
    """Index of pieces given as one sequence in which symbol 0 ends each piece."""

    def __init__(self, sequence: np.ndarray, piece: np.ndarray, keep: tuple[int, ...] = ()) -> None:
        self.sequence = sequence
        rank, self.classes = suffix_ranks(sequence, piece, keep)
        self.order = np.empty(len(sequence), np.int64)
        self.order[rank] = np.arange(len(sequence))
        size = int(sequence.max()) + 1 if len(sequence) else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size))])
        self.tree = WaveletMatrix(sequence[self.order - 1], max(1, (size - 1).bit_length()))
        self.origin = self.tree.start(np.arange(size))

    def matching(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns sequence[at : at + length], searched backwards from their ends.

        (lo, hi, matched): the suffix interval when the search stopped and how many
        words it had matched. It stops at length, or as soon as only the pattern's
        own place is left.
        """
        c = self.sequence[at + length - 1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        matched = np.ones(len(at), np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for j in range(length - 2, -1, -1):
            if not len(live):
                break
            c = self.sequence[at[live] + j]
            origin = self.origin[c]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live], origin)
            hi[live] = self.first[c] + self.tree.rank(c, hi[live], origin)
            matched[live] += 1
            live = live[hi[live] - lo[live] > 1]
        return lo, hi, matched


class RangeMin:
    """Smallest value of any interval, by a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            row, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(row[: len(row) - half], row[half:]))

    def min(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi], never empty."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << int(k))])
        return out
