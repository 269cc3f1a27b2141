"""Near-dedup with HyperMinHash.

One hash of each word shingle chooses a register by its first bits; the register
keeps the leading-zero count of the smallest rest and the mantissa bits after
it. Empty registers borrow a filled one by a fixed walk. Bands of registers give
candidate buckets. Pairs are first judged by a parity bitmap of their sets, which
never rejects a similar pair, and, where sets are large, by the collision-corrected
Jaccard estimate; then they are confirmed on full shingle sets.

Documents with one shingle set are one class and only one of its rows goes on.
Candidates with too many shingles of their own leave. A bucket's members are
compared with one hub, not with each other, over rounds with other hubs; members
of buckets that stay divided are then paired by an exact prefix filter on their
rarest shingles, and the bitmaps decide inside that join which pairs exist at all.
So no link between different sets that share a bucket is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import wordvec as W
from lectern.llm.graph import components
from lectern.llm.shared import Stages

REGISTERS = 256
INDEX_BITS = 8
MANTISSA = 10
#: The chance to miss a pair right at the threshold; standard errors below it at which the estimate rejects a pair, and sets it judges: fewer shingles leave too many registers borrowed.
MISS = 1e-6
ERRORS = 5.0
ESTIMATED = 512
#: Bits of a set's parity bitmap, in 64-bit words.
PARITY = 16
#: Rounds in which a bucket's members meet one hub each time; what they leave divided, the exact filter pairs. One round leaves large parts of a group apart, whose members the filter then pairs.
HUB_ROUNDS = 2
#: Expected collisions of two unrelated registers, as a share at 2**-MANTISSA.
_COLLISION = 0.169919487159739 / 2**MANTISSA
_ODD = [W.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_WALK = np.random.default_rng(5).integers(0, REGISTERS, (96, REGISTERS))
#: Where a walk ends without a filled register, the first filled one in an order of each register's own.
_RANK = np.random.default_rng(6).permuted(np.tile(np.arange(REGISTERS, dtype=np.uint16), (REGISTERS, 1)), axis=1)


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with a chance of MISS at most."""
    for rows in range(16, 0, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    raise ValueError("percent is too low")


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds by text.

    A text of fewer than width words is one shingle; one without words has none.
    """
    starts, ends, first = W.words(buf, off)
    h = W.hashes(buf, starts, ends, lower=True)
    n = np.diff(first)
    total = np.zeros(len(h), np.uint64)
    for i in range(width):
        total[: len(h) - i] += W.mix(h[i:] + W.U(i + 1)) * _ODD[i % len(_ODD)]
    total = W.mix(total)
    bounds, parts = [0], []
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            x = np.sort(total[a : b - width + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
        elif b > a:
            x = np.zeros(1, np.uint64)
            for j in range(a, b):
                x += W.mix(h[j : j + 1] + W.U(j - a + 1)) * _ODD[(j - a) % len(_ODD)]
            x = W.mix(x ^ W.U(b - a))
        else:
            x = h[:0]
        parts.append(x)
        bounds.append(bounds[-1] + len(x))
    return (np.concatenate(parts) if parts else h[:0]), np.array(bounds)


def registers(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set of sorted hashes; rows of empty sets are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(x):
        return out
    owner = W.owner(bounds)
    slot = (x >> W.U(64 - INDEX_BITS)).astype(np.int64)
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1])])
    rest = (x[new] << W.U(INDEX_BITS)) | W.U((1 << INDEX_BITS) - 1)
    # the float's exponent is the leading-zero count, its leading fraction bits the mantissa
    high = (rest >> W.U(11)).astype(np.float64).view(np.uint64)
    zeros = W.U(1023 + 52) - (high >> W.U(52))
    mantissa = (high >> W.U(52 - MANTISSA)) & W.U((1 << MANTISSA) - 1)
    value = (((zeros + W.U(1)) << W.U(MANTISSA)) | mantissa).astype(np.uint16)
    out[owner[new], slot[new]] = value
    filled = out > 0
    some = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    own = out[some]
    res = own.copy()
    for walk in _WALK:
        left = np.flatnonzero((res == 0).any(axis=1))
        if not len(left):
            break
        res[left] = np.where(res[left] == 0, own[left][:, walk], res[left])
    for i in np.flatnonzero((res == 0).any(axis=1)):
        at = np.flatnonzero(own[i])
        gap = np.flatnonzero(res[i] == 0)
        res[i, gap] = own[i, at[np.argmin(_RANK[gap][:, at], axis=1)]]
    out[some] = res
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band."""
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[7], (len(regs), bands)).copy()
    cells = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    for r in range(rows):
        x = W.mix(x + (cells[:, :, r] + W.U(1)) * _ODD[r % 7])
    return x


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    same = (a == b).mean(axis=1)
    return np.clip((same - _COLLISION) / (1 - _COLLISION), 0, 1)


def parity(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of PARITY words for each set: bit b is the parity of its shingles that hash to b.

    The bitmaps of two sets differ in at most as many bits as the sets differ in shingles.
    """
    n, size = len(bounds) - 1, 64 * PARITY
    out = np.zeros((n, PARITY), np.uint64)
    for lo in range(0, n, 1024):
        hi = min(n, lo + 1024)
        part = x[bounds[lo] : bounds[hi]]
        at = W.owner(bounds[lo : hi + 1] - bounds[lo]) * size + (part & W.U(size - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=(hi - lo) * size) & 1).astype(np.uint8)
        out[lo:hi] = np.packbits(odd, bitorder="little").view("<u8").reshape(-1, PARITY)
    return out


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, n, k1, k2 (a 128-bit key of the set) and registers; nulls where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(2)):
                x, bounds = shingles(buf, off, width)
                regs = registers(x, bounds)
                keys = []
                for odd in (_ODD[3], _ODD[5]):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(x ^ odd), dtype=np.uint64)])
                    keys.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)))
                n = np.diff(bounds)
                raw = regs.astype("<u2").tobytes()
                blobs = [raw[2 * REGISTERS * i : 2 * REGISTERS * (i + 1)] if k else None for i, k in enumerate(n)]
                own = [batch.column(i).slice(lo, hi - lo).cast(pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), *keys, pa.array(blobs, pa.binary())], names=["doc_id", "mark", "n", "k1", "k2", "regs"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n long, k1 long, k2 long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _buckets(reps: DataFrame, percent: int) -> DataFrame:
    bands, rows = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = band_keys(_matrix(part.column(1)), bands, rows)
                rep = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "regs").mapInArrow(run, "key long, rep long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, n, regs, bits, x): the sorted shingle hashes of each candidate, and their parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(2)):
                x, bounds = shingles(buf, off, width)
                raw = memoryview(x.astype("<u8").tobytes())
                bits = pa.array(parity(x, bounds).astype(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * PARITY), bits)
                blobs = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                rep, regs = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([rep, pa.array(np.diff(bounds).astype(np.int64)), regs.cast(pa.binary()), lists, blobs], names=["rep", "n", "regs", "bits", "x"])

    return texts.select("rep", "regs", "text").mapInArrow(run, "rep long, n long, regs binary, bits array<long>, x binary")


def _may_link(percent: int, n: str, m: str, bits: Callable[[int], tuple[Column, Column]]) -> Column:
    """Whether bitmaps differ in no more bits than two similar sets of n and m shingles may differ in shingles."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(p.bitwiseXOR(q)) for p, q in map(bits, range(PARITY))))
    return (100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, judged: bool = False) -> DataFrame:
    """The pairs (a, b, ca, cb) whose full sets reach the threshold; bitmaps (unless judged already) and estimates rule most others out first."""
    t = percent / 100
    floor = t - ERRORS * math.sqrt(t * (1 - t) / REGISTERS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                near = estimate(_matrix(part.column(6)), _matrix(part.column(7)))
                for i, (p, q) in enumerate(zip(part.column(4), part.column(5), strict=True)):
                    p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (p, q))
                    p, q = (p, q) if len(p) <= len(q) else (q, p)
                    if len(p) >= ESTIMATED and near[i] < floor:
                        continue
                    found = np.searchsorted(q, p)
                    common = int(np.count_nonzero(q[np.minimum(found, len(q) - 1)] == p)) if len(q) else 0
                    if 100 * common >= percent * (len(p) + len(q) - common):
                        good.append(lo + i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in range(4)], names=["a", "b", "ca", "cb"])

    def both(frame: DataFrame, *what: str) -> DataFrame:
        one, two = (sets.select(F.col("rep").alias(c), *(F.col(w).alias(f"{w}_{c}") for w in what)) for c in "ab")
        return frame.join(two, "b").join(one, "a").select("a", "b", "ca", "cb", *(f"{w}_{c}" for w in what for c in "ab"))

    if not judged:
        bits = lambda i: (F.col("bits_a")[i], F.col("bits_b")[i])
        pairs = both(pairs, "n", "bits").where(_may_link(percent, "n_a", "n_b", bits)).select("a", "b", "ca", "cb")
    return both(pairs, "x", "regs").mapInArrow(verify, "a long, b long, ca long, cb long")


def _tokens(sets: DataFrame) -> DataFrame:
    """(x, rep): the shingles of each candidate's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                blobs = batch.column(1).slice(lo, 512).to_pylist()
                x = np.frombuffer(b"".join(blobs), "<i8")
                rep = np.repeat(batch.column(0).slice(lo, 512).to_numpy(), [len(v) // 8 for v in blobs])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(rep)], names=["x", "rep"])

    return sets.select("rep", "x").mapInArrow(run, "x long, rep long")


def _lonely(sets: DataFrame) -> DataFrame:
    """(rep, u): how many shingles of each candidate no other candidate has."""
    alone = _tokens(sets).groupBy("x").agg(F.min("rep").alias("rep"), F.max("rep").alias("hi")).where("rep = hi")
    return alone.groupBy("rep").agg(F.count(F.lit(1)).alias("u"))


def _prefix_pairs(named: DataFrame, sets: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """All pairs of named members in different components that can be similar, without pairing buckets out.

    In one order of shingles, rarest first, two similar sets share one of their
    first n - ceil(percent * n / 100) + 1; so only sharers of such a shingle meet,
    only where the rest of both sets can still reach the similarity, and only where
    their bitmaps differ no more than the sets may.
    """
    open_ = named.select("rep", "n", "s", "comp").distinct().join(sets.select("rep", "bits"), "rep")
    tokens = stages.save(_tokens(sets.join(named.select("rep").distinct(), "rep", "left_semi")), "tokens")
    counts = stages.save(tokens.groupBy("x").agg(F.count(F.lit(1)).alias("df")), "counts")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "x")).alias("i")
    first = tokens.join(counts, "x").select("x", "rep", "df", place).join(open_, "rep")
    first = stages.save(first.where(F.col("df") > 1).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), "prefixes")
    many = first.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x")
    first = first.join(stages.save(many, "divided"), "x").drop("df")
    first = first.select("*", *(F.col("bits")[i].alias(f"p{i}") for i in range(PARITY))).drop("bits")
    other = first.select("x", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("comp").alias("cb"), F.col("i").alias("j"), *(F.col(f"p{i}").alias(f"q{i}") for i in range(PARITY)))
    reach = 1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    pairs = first.withColumnRenamed("rep", "a").withColumnRenamed("comp", "ca").join(other, "x")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _fits(percent) & (100 * reach >= percent * (F.col("n") + F.col("m") - reach)))
    return pairs.where(_may_link(percent, "n", "m", lambda i: (F.col(f"p{i}"), F.col(f"q{i}"))))


def _fits(percent: int) -> Column:
    """Whether set sizes n, m and shareable shingles s, t allow two sets the similarity at all."""
    common = F.least("s", "t")
    return 100 * common >= percent * (F.col("n") + F.col("m") - common)


def near_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of non-white-space, A-Z as a-z; a document's set holds its
    distinct shingles of width words. Documents link where 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable. Texts without
    words, null ones too, link with nothing. doc_id is integral; rows that repeat
    one count as one document with the links of all of them (a row without words
    still links with nothing); a row without a doc_id links with nothing, has no
    component and is kept. Texts of any length are one set; empty tables give empty results. Only doc_id and text are read, so other
    columns cannot clash.
    """
    stages = Stages(df.sparkSession, "near")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    cards = stages.save(_sketches(docs, width), "sketches")
    real = cards.where("n > 0 AND doc_id IS NOT NULL")
    reps = real.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("s"), F.first("regs").alias("regs"))
    reps = stages.save(reps.select("k1", "k2", "n", F.monotonically_increasing_id().alias("rep"), F.col("s.doc_id").alias("low"), F.col("s.mark").alias("mark"), "regs"), "classes")
    buckets = _buckets(reps, percent)
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    shared = stages.save(shared, "shared")  # a table of its own, so that the join can split a frequent key
    members = stages.save(buckets.join(shared, "key"), "buckets")
    held = reps.select(F.col("low").alias("doc_id"), "mark", "rep", "regs").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = stages.save(_sets(docs.join(held, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]), width), "sets")
    spare = sets.select("rep", "n").join(_lonely(sets), "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))
    nodes = stages.save(spare.where(100 * F.col("s") >= percent * F.col("n")), "nodes")
    comps = _one_document(cards, reps, _link(members, nodes, sets, stages, percent), stages)
    lows = comps.join(reps.select("rep", "low"), "rep").groupBy("comp").agg(F.min("low").alias("least"))
    known = reps.select("k1", "k2", "n", "rep", "low").join(comps, "rep", "left").join(lows, "comp", "left")
    known = known.select("k1", "k2", "n", F.coalesce("least", "low").alias("least"))
    out = cards.select("doc_id", "n", "k1", "k2").join(known, ["k1", "k2", "n"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    stages.drop(members, sets, nodes)
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """df without the rows that near_groups() does not keep: of each group the smallest doc_id stays.

    Rows that repeat the doc_id that stays all stay; other columns go along as they are.
    """
    gone = near_groups(df, text, doc_id, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(doc_id).alias("id"))
    return rows.join(gone, F.col("id") == F.col("_gone"), "left_anti").select("row.*")


def _joined(comps: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """comps (rep, comp) after joining the components on each edge (a, b)."""
    joined = components(edges, stages).withColumnRenamed("id", "was").withColumnRenamed("comp", "now")
    moved = comps.join(joined, F.col("comp") == F.col("was"), "left").select("rep", F.coalesce("now", "comp").alias("comp"))
    return stages.save(moved, "comps")


def _link(members: DataFrame, nodes: DataFrame, sets: DataFrame, stages: Stages, percent: int) -> DataFrame:
    """(rep, comp): components over the classes of nodes (rep, n, s) that share a bucket of members (key, rep)."""
    comps = stages.save(nodes.select("rep", F.col("rep").alias("comp")), "comps")
    open_ = stages.save(members.join(nodes, "rep"), "able")
    for turn in range(HUB_ROUNDS + 1):
        named = open_.join(comps, "rep")
        if turn:  # buckets of two were settled by the first round
            named = stages.save(named, "named")
            mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi AND k > 2")
            open_ = stages.save(named.join(stages.save(mixed.select("key"), "mixed"), "key").drop("comp"), "open")
            if open_.isEmpty():
                break
            named = open_.join(comps, "rep")
        last = turn == HUB_ROUNDS
        if last:
            pairs = _prefix_pairs(named, sets, stages, percent)
        else:
            order = F.col("rep") if turn == 0 else F.xxhash64(F.lit(turn), "rep")
            hubs = named.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "n", "s", "comp")).alias("h"))
            hubs = hubs.select("key", F.col("h.rep").alias("b"), F.col("h.n").alias("m"), F.col("h.s").alias("t"), F.col("h.comp").alias("cb"))
            hubs = stages.save(hubs, "hubs")
            pairs = named.withColumnRenamed("comp", "ca").withColumnRenamed("rep", "a").join(hubs, "key")
            pairs = pairs.where((F.col("a") != F.col("b")) & (F.col("ca") != F.col("cb")) & _fits(percent))
        pairs = stages.save(pairs.select("a", "b", "ca", "cb").distinct(), "pairs")
        found = stages.save(_confirm(pairs, sets, percent, judged=last), "found")
        if not found.isEmpty():
            comps = _joined(comps, found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), stages)
    return comps


def _one_document(cards: DataFrame, reps: DataFrame, comps: DataFrame, stages: Stages) -> DataFrame:
    """comps after joining the classes of rows that repeat a doc_id."""
    own = F.struct("k1", "k2", "n")
    several = cards.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id")
    several = stages.save(several, "several")
    if several.isEmpty():
        return comps
    held = cards.join(several, "doc_id").select("doc_id", "k1", "k2", "n").join(reps.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).select("doc_id", "rep").distinct()
    held = stages.save(held, "held")
    alone = held.select("rep").distinct().join(comps, "rep", "left_anti").select("rep", F.col("rep").alias("comp"))
    comps = stages.save(comps.unionByName(alone), "comps")
    held = held.join(comps, "rep")
    first = held.groupBy("doc_id").agg(F.min("comp").alias("a"))
    return _joined(comps, held.join(first, "doc_id").select("a", F.col("comp").alias("b")), stages)
