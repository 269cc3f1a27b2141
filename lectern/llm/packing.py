"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are the binary digits of n
(whole sequences first); pieces of one length form a bucket, and each is a
sequence of its own. No sequence crosses documents and none is padded, so the
work is one pass without a shuffle at any size.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as W

SEQUENCE = 2048
END_ID = 1
SLICE_BYTES = 2 << 20
CACHE_WORDS = 350_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int, ids array<int>"
# Punctuation that may close a word; no apostrophe, which starts tokens of its own.
_CLOSING = np.isin(np.arange(256), list(b".,;:!?*$%#&|()"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def binary_pieces(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths: n // longest whole ones, then the binary digits of the rest, falling."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length())) if (n % longest) >> k & 1]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Token ids of whole texts, remembering those of each word and each closing punctuation.

    Only for byte-level tokenizers that lower-case, drop white space and never let a
    token span letters and punctuation: then the ids of a word are those of its
    lower-case core and of what closes it. Cores of Latin letters go straight to the
    vocabulary's merges, all others through the whole tokenizer. The memory is
    bounded: a full one is emptied.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merges, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}

    def _ids(self, part: str) -> bytes:
        if part.isalpha() and max(part) < "\u0250" and (low := part.lower()).isalpha():
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.merges.tokenize(low)]
            return struct.pack(f"<{len(ids)}I", *ids)
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def lookup(self, parts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each part."""
        known = self.known
        if len(known) + len(parts) > self.limit:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = self._ids(p)
        return [known[p] for p in parts]

    @staticmethod
    def _parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, closing punctuation apart where it follows a letter or digit, and bounds by text."""
        starts, ends, first = W.words(buf, off)
        if not len(starts):
            return starts, ends, first
        core = np.maximum.accumulate(np.where(_CLOSING[buf], -1, np.arange(len(buf), dtype=np.int32)))[ends - 1].astype(np.int64) + 1
        core = np.maximum(core, starts + 1)
        last, before = buf[core - 1], buf[np.maximum(core - 2, 0)]
        latin = (before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
        core = np.where((last < 128) & ~W.NOT_ALNUM[last] | latin, core, ends)
        two = core < ends
        at = np.cumsum(1 + two) - 1 - two
        a, b = np.empty(len(starts) + two.sum(), np.int64), np.empty(len(starts) + two.sum(), np.int64)
        a[at], b[at] = starts, core
        a[at[two] + 1], b[at[two] + 1] = core[two], ends[two]
        return a, b, np.append(at, len(a))[first]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in one buffer, and where each text's begin and end.

        Each different part is looked up once; its ids are then dealt to its places.
        """
        if b"<|" in buf.tobytes():  # names of special tokens keep their case and punctuation
            starts, ends, first = W.words(buf, off)
        else:
            low = _LOWER[buf]
            # a capital before a mark keeps its case: the tokenizer composes the two before it lower-cases
            buf = np.where((low != buf) & (np.append(buf[1:], np.uint8(0)) >= 128), buf, low)
            starts, ends, first = self._parts(buf, off)
        _, at, which = np.unique(W.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        found = self.lookup([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        base = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        ids = flat[np.repeat(base[which] - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])[first]


_loaded: dict[str, WordTokens] = {}


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", longest: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, offset, bucket, ids, sequence_id.

    tokenizer is the path of a tokenizers file, the same on every machine. Each row
    of df is a document, repeated rows too; a null or empty text is the end id
    alone; a null doc_id stays null; a text of any length is cut whole; an empty table
    gives an empty result. ids are the token ids of the piece, ids_crc32 is over
    their little-endian 32-bit form, bucket is log2 of the length and offset is 0.
    sequence_id is unique in the result but numbers the pieces of one partitioning of
    df. Only text and doc_id are read, so other columns cannot clash.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType([df.schema[doc_id]] + StructType.fromDDL(PIECES).fields)
    schema = to_arrow_schema(full)
    id_type = schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        words = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordTokens(tokenizer))
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(1), SLICE_BYTES):
                ids, bounds = words.encode(buf, off)
                rows, cols = [], [[] for _ in range(6)]
                for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist()), lo):
                    raw, at = memoryview(ids[a:b].tobytes() + end), 0
                    for n in binary_pieces(b - a + 1, longest):
                        rows.append(i)
                        for to, x in zip(cols, (at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), b - a + 1, 0, n.bit_length() - 1), strict=True):
                            to.append(x)
                        at += n
                doc_column = batch.column(0).take(pa.array(rows, pa.int64())).cast(id_type)
                flat = np.insert(ids, bounds[1:], end_id).astype(np.int32)  # pieces follow one another without a gap
                at = np.concatenate([[0], np.cumsum(cols[1])]).astype(np.int32)
                sequences = pa.ListArray.from_arrays(pa.array(at), pa.array(flat), type=schema.field("ids").type)
                yield pa.RecordBatch.from_arrays([doc_column, *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:-1], strict=True)), sequences], schema=schema)

    return df.select(doc_id, text).mapInArrow(run, full).withColumn("sequence_id", F.monotonically_increasing_id())
