"""Words of many texts at once: numpy over the buffers of an Arrow string column.

A word is a maximal run of bytes other than the six ASCII white-space bytes, so
UTF-8 never needs decoding. Hashes are 64-bit polynomials over random byte
values, so equal words have equal hashes in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 2 << 20
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters and digits: all other ASCII bytes stand between words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 2**64))):
            a = np.full(max(n, _CHUNK + 4096), base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (lo, hi, bytes, offsets from 0) of about limit bytes; a longer text is a run of its own."""
    if not len(column):
        return
    buf, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and first[i]: the number of words before text i. apart: bytes between words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = apart[buf]
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    at = off[:-1][off[:-1] < len(buf)]
    start[at] = ~space[at]
    at = off[1:][off[1:] > 0] - 1
    end[at] = ~space[at]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; lower: A-Z count as a-z."""
    table, n, i = (_LOWER if lower else _BYTES), len(starts), 0
    out = np.empty(n, np.uint64)
    while i < n:
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _CHUNK, "right")))
        b = int(ends[j - 1])
        power, inverse = _power(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[buf[a:b]] * power[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def hash_text(word: str, lower: bool = False) -> int:
    """The hash of one word, as a signed 64-bit number."""
    raw = np.frombuffer(word.encode(), np.uint8)
    h = hashes(raw, np.array([0]), np.array([len(raw)]), lower)
    return int(h.astype(np.int64)[0])


def owner(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
