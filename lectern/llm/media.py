"""Signature sniffing of media columns.

An Aho-Corasick automaton finds every magic number of a binary value in one
pass; a validator for each format then walks the structure and its lengths, so a
hit counts only where a whole, well-formed file stands. From that follow the
real type of a value (against a declared one) and the files embedded in it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Magic numbers and the type whose validator they call.
MAGIC = (
    (b"RIFF", "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"P5\n", "image/x-portable-graymap"),
    (b".snd", "audio/basic"),
)
UNIT = 64
SNIFF_SCHEMA = "declared_type string, detected_type string, corrected boolean, embedded array<struct<type:string,start:long,length:long>>"
STORE_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, declared_type string, media_type string, corrected boolean, feature string, media binary, embedded array<struct<type:string,start:long,length:long,content:binary>>"
#: Bytes of media in an output batch, about.
BATCH_BYTES = 8 << 20


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def _wav(b: bytes, at: int) -> int:
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        seen.add(b[p : p + 4])
        p += 8 + size + size % 2
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        if p == at + 8 and kind != b"IHDR":
            return 0
        p += 12 + size
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) - at < 14:
        return 0
    p = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(b):
            p += 11 + (3 * 2 ** ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 - at
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return 0
        p += 2 + size
        if mark == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if b[p + 1] == 0xD9:
                return p + 2 - at
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) - at < 54:
        return 0
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    ok = not zero and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and offset >= 14 + header
    return size if ok and offset + row * abs(height) == size <= len(b) - at else 0


def _pgm(b: bytes, at: int) -> int:
    fields, p = [], at + 3
    while len(fields) < 3:
        end = p
        while end < min(len(b), p + 11) and 48 <= b[end] <= 57:
            end += 1
        if not p < end < min(len(b), p + 11) or b[end] not in b" \n\t":
            return 0
        fields.append(int(b[p:end]))
        p = end + 1
    size = p - at + fields[0] * fields[1] * (2 if fields[2] > 255 else 1)
    return size if 0 < fields[2] < 65536 and fields[0] * fields[1] and at + size <= len(b) else 0


def _au(b: bytes, at: int) -> int:
    if len(b) - at < 24:
        return 0
    offset, size, coding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    ok = offset >= 24 and 1 <= coding <= 27 and 0 < rate < 10**6 and 0 < channels < 64
    return offset + size if ok and at + offset + size <= len(b) else 0


VALIDATORS = {
    "audio/wav": _wav,
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "image/x-portable-graymap": _pgm,
    "audio/basic": _au,
}


def find_media(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid file in blob, by start; those inside another one too."""
    hits = ((end + 1 - size, kind) for end, (size, kind) in _AUTOMATON.iter(blob.decode("latin-1")))
    return sorted(((kind, at, n) for at, kind in hits if (n := VALIDATORS[kind](blob, at))), key=lambda x: (x[1], -x[2]))


def sniffed(blob: bytes, declared: str | None) -> tuple[str | None, bool, list[tuple[str, int, int]]]:
    """(real type, whether that corrects the declared one, files that start later) of a value."""
    found = find_media(blob)
    real = next((k for k, at, _ in found if at == 0), None)
    return real, real is not None and real != declared, [x for x in found if x[1]]


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """payload as the unsigned 8-bit samples of a mono WAV file."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples_of(wav: bytes) -> bytes:
    """The data chunk of a WAV file that the validator accepts."""
    p, end = 12, 8 + struct.unpack_from("<I", wav, 4)[0]
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", wav, p)
        if kind == b"data":
            return wav[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    raise ValueError("no data chunk")


def _arrow_schema(df: DataFrame, columns: list[str], more: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = StructType([df.schema[c] for c in columns])
    extra = StructType.fromDDL(more)
    full = StructType(kept.fields + extra.fields)
    return full, to_arrow_schema(full)


def sniff(df: DataFrame, content: str, declared: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Real type and embedded files of a binary column.

    One row per input row: the columns of keep, then declared_type, detected_type
    (the valid file at byte 0; null where there is none), corrected (the declared
    type is another one) and embedded (valid files that start later). Null content
    counts as empty bytes; a null declared type is corrected whenever a type is
    found; a value of any length is walked whole; rows that repeat give equal rows;
    an empty table gives an empty result. Other columns are not read, so their names
    cannot clash.
    """
    keep = list(keep)
    full, schema = _arrow_schema(df, keep, SNIFF_SCHEMA)
    names = [*keep, content, *([declared] if declared else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(len(keep) + 1).to_pylist() if declared else [None] * batch.num_rows
            rows: list[list] = [[], [], [], []]
            for i, was in enumerate(said):
                real, corrected, later = sniffed(batch.column(len(keep))[i].as_py() or b"", was)
                inner = [{"type": k, "start": at, "length": n} for k, at, n in later]
                for to, x in zip(rows, (was, real, corrected, inner), strict=True):
                    to.append(x)
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(x, schema.field(len(keep) + i).type) for i, x in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return df.select(*names).mapInArrow(run, full)


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), declared: str = "application/octet-stream") -> DataFrame:
    """Each text as the samples of a WAV file, read back through the sniffer, with its figures.

    The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple
    of 64. The stored file is sniffed under the declared type, which the type found
    corrects, and the samples of the file found are the payload read back. Null text
    counts as empty; texts of any length are one file; equal texts, repeated rows
    too, give equal rows; an empty table gives an empty result. feature: type found,
    sum of samples, crossings of the mid level, embedded files. media is the stored
    file, embedded the valid files inside it, each carved out. Only keep and text are
    read, so other columns cannot clash.
    """
    keep = list(keep)
    full, schema = _arrow_schema(df, keep, STORE_SCHEMA)

    def one(raw: bytes) -> tuple:
        media = wav_of(raw + b"\0" * ((-len(raw)) % UNIT or (0 if raw else UNIT)))
        kind, corrected, later = sniffed(media, declared)
        if kind != "audio/wav":
            raise ValueError("the stored file is not whole")
        back = samples_of(media)
        x = np.frombuffer(back, np.uint8)
        crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
        feature = f"{kind};sum={int(x.sum(dtype=np.int64))};crossings={crossings};embedded={len(later)}"
        inner = [{"type": k, "start": a, "length": n, "content": media[a : a + n]} for k, a, n in later]
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), declared, kind, corrected, feature, media, inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)).cast(pa.large_string()), "").cast(pa.large_binary())
            lo, rows, held = 0, [], 0
            for hi, x in enumerate(texts, 1):
                rows.append(one(x.as_py()))
                held += len(rows[-1][10])
                if held < BATCH_BYTES and hi < len(texts):
                    continue
                kept = [batch.column(i).slice(lo, hi - lo).cast(schema.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, schema.field(len(keep) + i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=schema)
                lo, rows, held = hi, [], 0

    return df.select(*keep, text).mapInArrow(run, full)
