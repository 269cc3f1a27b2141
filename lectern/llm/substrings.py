"""Substring dedup over shards of compressed full-text indexes.

A window of 50 words belongs to its minimiser: the smallest hash among its 43
8-word grams, leftmost if tied. Equal windows have equal minimisers, so all
occurrences of a window meet in one shard while a text is cut into few pieces
(runs of windows with one minimiser). Pieces whose minimiser no other document
has are done; of the rest each different piece enters its shard's FM-index once,
and backward search of its windows gives the smallest document that holds each.
A minimiser with very many different pieces is split: its windows become pieces
of their own, keyed by their whole content.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as W
from lectern.llm.fmindex import FMIndex, RangeMin
from lectern.llm.shared import Stages

WINDOW = 50
GRAM = 8
#: Words of pieces in a shard, about; different pieces of a minimiser beyond which it is split into windows.
SHARD_WORDS = 400_000
HOT_PIECES = 2000
_ODD = [W.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_AREA = 1 << 20


def _content(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of words follows."""
    power, _ = W._power(len(h) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h) * power[: len(h)], dtype=np.uint64)])


def _run_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, inverse = W._power(len(prefix))
    return W.mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64) * _ODD[1])


def cut(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of texts given by word hashes: (text, start, windows, minimiser, content), start in words of the text."""
    span, out = window - gram + 1, []
    grams = np.zeros(max(len(h) - gram + 1, 0), np.uint64)
    for i in range(gram):
        grams += W.mix(h[i : i + len(grams)] + W.U(i)) * _ODD[i]
    grams = W.mix(grams)
    prefix = _content(h)
    n = max(len(h) - window + 1, 0)
    text = np.searchsorted(first, np.arange(n), "right") - 1
    whole = np.arange(n) + window <= first[text + 1]
    for lo in range(0, n, _AREA):
        hi = min(n, lo + _AREA)
        part = grams[lo : hi + span - 1]
        low = (part & ~W.U(0x3FFFFF)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[: hi - lo], low[span - width : span - width + hi - lo])
        pos = (low & W.U(0x3FFFFF)).astype(np.int64)
        ok = whole[lo:hi]
        new = ok & np.concatenate([[True], (pos[1:] != pos[:-1]) | ~ok[:-1]])
        at = np.flatnonzero(new)
        stop = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]]))
        a, b = at + lo, stop + lo + 1
        out.append((text[a], a - first[text[a]], b - a, part[pos[at]].astype(np.int64), _run_hash(prefix, a, b + window - 1).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


DOCS = "doc_id long, mark long, pieces array<struct<start:int,n:int,key:long,hash:long>>"


def _cut_all(docs: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DOCS))
    item = schema.field(2).type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(2)):
                starts, ends, first = W.words(buf, off)
                text, start, n, key, content = cut(W.hashes(buf, starts, ends), first)
                fields = [pa.array(x.astype(t)) for x, t in ((start, np.int32), (n, np.int32), (key, np.int64), (content, np.int64))]
                at = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, fields=list(item)), type=schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], schema=schema)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, DOCS)


SHIPPED = "key long, hash long, n int, low long, words binary, origin_key long, origin_hash long, place int"


def _ship(rows: DataFrame, window: int) -> DataFrame:
    """The words of each wanted piece; a hot one as single windows keyed by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, wanted in zip(batch.column(0), batch.column(1), strict=True):
                words = (body.as_py() or "").encode().split()
                out: list[tuple] = []
                for w in wanted.as_py():
                    a, n = w["start"], w["n"]
                    if not w["hot"]:
                        out.append((w["key"], w["hash"], n, w["low"], b" ".join(words[a : a + n + window - 1]), None, None, None))
                        continue
                    for i in range(n):
                        joined = b" ".join(words[a + i : a + i + window])
                        own = int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "big", signed=True)
                        out.append((own, own, 1, w["low"], joined, w["key"], w["hash"], i))
                cols = list(zip(*out, strict=True)) or [[]] * 8
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "hash", "n", "low", "words", "origin_key", "origin_hash", "place"])

    return rows.mapInArrow(run, SHIPPED)


ANSWERS = "key long, hash long, n int, sizes array<int>, lows array<long>"


def match_shard(words: list[bytes], low: np.ndarray, count: np.ndarray, window: int) -> list[tuple[list[int], list[int]]]:
    """For each piece, runs of (windows, smallest document that holds them) from one FM-index of all pieces."""
    off = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    buf = np.frombuffer(b"".join(words), np.uint8)
    starts, ends, first = W.words(buf, off)
    symbol = np.unique(W.hashes(buf, starts, ends), return_inverse=True)[1] + 1
    owner = W.owner(first)
    sequence = np.zeros(len(symbol) + len(words), np.int64)
    sequence[np.arange(len(symbol)) + owner] = symbol
    base = first + np.arange(len(first))
    piece = np.repeat(np.arange(len(words)), np.diff(base))
    half = 1 << (window.bit_length() - 1)
    index = FMIndex(sequence, piece, (half,))
    of = np.repeat(np.arange(len(words)), count)
    at = base[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    same = index.classes[half]
    pattern = same[at] * (len(sequence) + 1) + same[at + window - half]
    _, one, which = np.unique(pattern, return_index=True, return_inverse=True)  # equal patterns are searched once
    lo, hi, matched = index.matching(at[one], window)
    whole = (matched == window) & (hi - lo > 1)
    smallest = low[of[one]].copy()
    if whole.any():
        smallest[whole] = RangeMin(low[piece[index.order]]).min(lo[whole], hi[whole])
    result = smallest[which]
    new = np.concatenate([[True], (result[1:] != result[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(of)))
    bounds = np.searchsorted(of[head], np.arange(len(words) + 1))
    return [(size[a:b].tolist(), result[head[a:b]].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _answer(shipped: DataFrame, shards: int, window: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ANSWERS))

    def run(table: pa.Table) -> pa.Table:
        count = table["n"].to_numpy().astype(np.int64)
        runs = match_shard(table["words"].to_pylist(), table["low"].to_numpy(), count, window)
        return pa.table([table["key"].combine_chunks(), table["hash"].combine_chunks(), table["n"].combine_chunks(), pa.array([r[0] for r in runs], schema.field(3).type), pa.array([r[1] for r in runs], schema.field(4).type)], schema=schema)

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return shipped.select(shard, "key", "hash", "n", "low", "words").groupBy("shard").applyInArrow(run, ANSWERS)


APPLIED = "doc_id long, mark long, n_removed long, new_text string, removed array<struct<start:int,end:int>>"


def _apply(rows: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(APPLIED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, gaps = [], [], []
            for body, cuts in zip(batch.column(2), batch.column(3), strict=True):
                words = (body.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for c in cuts.as_py():
                    edge[c["a"]] += 1
                    edge[c["b"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                gaps.append([{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)])
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, schema.field(3).type), pa.array(gaps, schema.field(4).type)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.select("doc_id", "mark", "text", "cuts").mapInArrow(run, APPLIED)


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text, removed.

    kept_text is the kept words joined by spaces, kept_sha256 its digest; removed
    lists the runs of removed words (start, end), numbered from 0, end excluded.

    A word goes if a window of it also starts in a document with a smaller doc_id.
    Words are runs of non-white-space, unchanged. Null and empty texts have no words;
    texts shorter than a window lose none. doc_id is integral; rows that repeat one
    are one document, so they never remove each other; a row without one neither
    loses words nor makes others lose any. Only doc_id and text are read.
    """
    if (window, gram) != (WINDOW, GRAM):
        raise ValueError("the pieces are cut for the module's window and gram")
    spark = df.sparkSession
    stages = Stages(spark, "substr")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    cards = stages.save(_cut_all(docs), "cards")
    pieces = cards.where("doc_id IS NOT NULL").select("doc_id", "mark", F.inline("pieces"))
    keys = pieces.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("key")
    keys = stages.save(keys, "keys")  # a table of its own, so that the join can split a frequent key
    shared = stages.save(pieces.join(keys, "key"), "shared")
    source = F.min(F.struct("doc_id", "mark", "start")).alias("s")
    kinds = stages.save(shared.groupBy("key", "hash", "n").agg(source), "kinds")
    hot = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_PIECES).select("key", F.lit(True).alias("hot"))
    wanted = kinds.join(hot, "key", "left").select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.mark").alias("mark"),
        F.struct(F.col("s.start").alias("start"), "n", "key", "hash", F.col("s.doc_id").alias("low"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"),
    )
    some = shared.select("doc_id", "mark").distinct()
    texts = stages.save(docs.where("doc_id IS NOT NULL").join(some, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]), "texts")
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted"))
    shipped = stages.save(_ship(texts.join(lists, ["doc_id", "mark"]).select("text", "wanted"), window), "shipped")
    total = shipped.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    plain = shipped.where("origin_key IS NULL").select("key", "hash", "n", "low", "words")
    single = shipped.where("origin_key IS NOT NULL").groupBy("key", "hash", "n").agg(F.min("low").alias("low"), F.min("words").alias("words"))
    answers = stages.save(_answer(plain.unionByName(single.select(*plain.columns)), max(1, math.ceil(total / SHARD_WORDS)), window), "answers")
    places = shipped.where("origin_key IS NOT NULL").select("key", "hash", "origin_key", "origin_hash", "place")
    back = answers.select("key", "hash", F.element_at("lows", 1).alias("low")).join(places, ["key", "hash"])
    back = back.groupBy("origin_key", "origin_hash").agg(F.array_sort(F.collect_list(F.struct("place", "low"))).alias("p"))
    back = back.select(F.col("origin_key").alias("key"), F.col("origin_hash").alias("hash"), F.transform("p", lambda x: F.lit(1)).alias("sizes"), F.col("p.low").alias("lows"))
    both = answers.select("key", "hash", "sizes", "lows").unionByName(back)
    runs = shared.join(both, ["key", "hash"])
    ends = F.transform("sizes", lambda s, i: F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0), lambda a, x: a + x))
    lost = F.filter(
        F.zip_with(F.arrays_zip(F.col("sizes").alias("size"), ends.alias("end")), "lows", lambda r, low: F.struct(low.alias("low"), (F.col("start") + r["end"] - r["size"]).alias("a"), (F.col("start") + r["end"] + window - 1).alias("b"))),
        lambda r: r["low"] < F.col("doc_id"),
    )
    cuts = runs.select("doc_id", "mark", F.inline(lost)).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    changed = _apply(texts.join(cuts, ["doc_id", "mark"]))
    changed = changed.withColumn("new_sha", F.sha2("new_text", 256))
    # digests and counts before the join, so that texts travel only where they are asked for
    whole = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x20]+", " "))
    own = docs.select("doc_id", "mark", whole.alias("own_text"))
    n_words = F.when(F.col("own_text") == "", 0).otherwise(F.length("own_text") - F.length(F.replace("own_text", F.lit(" "), F.lit(""))) + 1)
    own = own.select("*", n_words.cast("long").alias("n_words"), F.sha2("own_text", 256).alias("own_sha"))
    out = own.join(changed, ["doc_id", "mark"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha", "own_sha").alias("kept_sha256"),
        F.coalesce("new_text", "own_text").alias("kept_text"), F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )
