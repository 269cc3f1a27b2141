"""Language-model scoring with an Elias-Fano n-gram trie in shards.

Texts become blocks of about 6 MB. Blocks ask word shards for the ids and counts
of their different words, then, order by order, trie shards for the children of
their different contexts: words under words, then words under word pairs. Each
shard builds one level from the training part of what it is asked, maps it into
memory and answers by context-relative successor search; a node's place is its
id, by which the next order's pointers find its children. Levels keep absolutely
discounted probabilities in one byte, on a logarithmic scale that reaches from 1
down to the least one the corpus can hold. Only different words and grams of a
block travel, and a context too frequent for one shard is dealt over several by
its successors. Messages between blocks and many shards go through relays, each
for a range of shards and a batch of blocks, so that a block sends a bounded
number of rows. A text's probability interpolates orders 3, 2 and 1; unknown
words are one class.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as W
from lectern.llm.eliasfano import Level
from lectern.llm.shared import Stages

BLOCK_BYTES = 6 << 20
#: Tokens a shard answers for, about; ranges of shards, and blocks in a batch, that a relay serves.
SHARD_TOKENS = 1_500_000
FAN = 128
#: The longest grams; the absolute discount; how often a word pair must occur to be a context.
ORDER = 3
DISCOUNT = 0.75
LEAST = 2
_END = W.U(0x5851F42D4C957F2D)
_NONE = (1 << 40) - 1


def step_for(tokens: int) -> float:
    """Powers of ten between two codes, so that they reach the least discounted probability among so many tokens."""
    return math.log10(max(tokens, 2) / (1 - DISCOUNT)) / 254


def quantise(p: np.ndarray, step: float) -> np.ndarray:
    """A one-byte code, from 1, of probabilities on a logarithmic scale."""
    code = 1 + np.rint(-np.log10(p) / step)
    if len(code) and not 1 <= code.min() <= code.max() <= 255:
        raise ValueError("a probability is beyond the codes")
    return code.astype(np.uint8)


def probabilities(step: float) -> np.ndarray:
    """The probability of each code; 0 for grams that never occurred."""
    return np.concatenate([[0.0], 10 ** (-np.arange(255) * step)])


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, all lowest bytes first, without the bytes that all have 0, compressed; ahead of them how many numbers of how many bytes."""
    x = np.ascontiguousarray(x.astype("<u8"))
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<QB", len(x), size) + pa.compress(x.view("u1").reshape(-1, 8)[:, :size].T.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    """What _pack() wrote, as 64-bit integers."""
    n, size = struct.unpack_from("<QB", raw)
    planes = np.frombuffer(pa.decompress(memoryview(raw)[9:], n * size, "zstd"), "u1").reshape(size, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<i8").reshape(-1)


def _pack_rising(x: np.ndarray) -> bytes:
    """_pack() of the steps of a rising sequence."""
    return _pack(np.diff(x, prepend=0))


def _unpack_rising(raw: bytes) -> np.ndarray:
    """What _pack_rising() wrote."""
    return np.cumsum(_unpack(raw))


BLOCK = "doc_ids binary, train binary, bounds binary, tokens binary, vocabulary binary, n_tokens long"
_BLOCK = ["doc_ids", "train", "bounds", "tokens"]


def _blocks(df: DataFrame) -> DataFrame:
    """Blocks of documents: ids, training flags, token bounds, tokens as numbers of the sorted word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in W.slices(batch.column(2), BLOCK_BYTES):
                starts, ends, first = W.words(buf, off)
                n = hi - lo
                bounds = first + np.arange(n + 1)
                h = np.empty(len(starts) + n, np.uint64)
                h[np.arange(len(starts)) + W.owner(first)] = W.hashes(buf, starts, ends, lower=True)
                h[bounds[1:] - 1] = _END
                vocabulary, tokens = np.unique(h, return_inverse=True)
                ids = pa.array(batch.column(0).slice(lo, n)).cast(pa.int64())
                packed = _pack(np.append(ids.fill_null(0).to_numpy().view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)))
                row = (packed, _pack(train[lo:hi]), _pack(bounds), _pack(tokens), _pack(vocabulary))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([len(tokens)])], names=[*_BLOCK, "vocabulary", "n_tokens"])

    return df.mapInArrow(run, BLOCK)


class Block:
    """A block row as arrays, as far as its stage knows them."""

    def __init__(self, row: dict) -> None:
        ids = _unpack(row["doc_ids"])
        self.ids, self.no_id = np.split(ids, 2)
        self.train = _unpack(row["train"]).astype(bool)
        self.bounds, self.tokens = _unpack(row["bounds"]), _unpack(row["tokens"]).astype(np.int32)
        self.learns = np.repeat(self.train, np.diff(self.bounds))
        for name in ("vocabulary", "word_ids", "counts"):
            if name in row:
                setattr(self, name, _unpack(row[name]))


# Messages. A block's row holds one parcel for each shard of a range; a shard's row holds parcels of one or more blocks.

ASKED = "part int, block long, items array<struct<shard:int,a:binary,b:binary,c:binary,d:binary,e:binary>>"
_PARCEL = pa.list_(pa.struct([("shard", pa.int32()), *((c, pa.binary()) for c in "abcde")]))
SAID = "shard int, items array<struct<block:long,x:binary,y:binary,z:binary,u:binary>>, n long, v long, n1 long, n2 long"
_ANSWER = pa.list_(pa.struct([("block", pa.int64()), *((c, pa.binary()) for c in "xyzu")]))


def _span(shards: int) -> int:
    """Shards in a range."""
    return -(-shards // FAN)


def _ask_rows(block: int, parcels: list[tuple[int, list[bytes]]], span: int) -> pa.RecordBatch:
    """A block's parcels (shard, contents), one row for each range of shards."""
    parts: dict[int, list[dict]] = {}
    for shard, contents in parcels:
        item = {"shard": shard, **dict(zip("abcde", contents, strict=False))}
        parts.setdefault(shard // span, []).append(item)
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(list(parts.values()), _PARCEL)], names=["part", "block", "items"])


def _deliver(asked: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(shard, items): rows of parcels for each shard."""
    span = _span(shards)
    fields = lambda i, block: F.struct(block.alias("block"), *(i[c].alias(c) for c in "abcde"))
    if span == 1:
        return asked.select(F.col("part").alias("shard"), F.transform("items", lambda i: fields(i, F.col("block"))).alias("items"))
    batch = F.pmod(F.xxhash64("block"), F.lit(-(-blocks // FAN))).alias("batch")
    met = asked.groupBy("part", batch).agg(F.collect_list(F.struct("block", "items")).alias("rows"))
    each = met.select("rows", F.explode(F.sequence(F.col("part") * span, F.col("part") * span + span - 1)).alias("shard"))
    own = F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["items"], lambda i: i["shard"] == F.col("shard")), lambda i: fields(i, r["block"]))))
    return each.select("shard", own.alias("items")).where(F.size("items") > 0)


def _return(said: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(block, items): rows of answers for each block."""
    span = _span(shards)
    fields = lambda i, shard: F.struct(shard.alias("shard"), *(i[c].alias(c) for c in "xyzu"))
    if span == 1:
        return said.select(F.inline("items"), "shard").select("block", F.array(F.struct("shard", *"xyzu")).alias("items"))
    batch = F.pmod(F.xxhash64(F.col("items")[0]["block"]), F.lit(-(-blocks // FAN))).alias("batch")
    met = said.groupBy(F.floor(F.col("shard") / span).alias("part"), batch).agg(F.collect_list(F.struct("shard", "items")).alias("rows"))
    each = met.select("rows", F.explode(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["items"], lambda i: i["block"]))))).alias("block"))
    own = F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["items"], lambda i: i["block"] == F.col("block")), lambda i: fields(i, r["shard"]))))
    return each.select("block", own.alias("items"))


def _items(table: pa.Table) -> list[dict]:
    return table["items"].combine_chunks().flatten().to_pylist()


def _replies(table: pa.Table, answers: list[tuple], sums: tuple[int, int, int, int] = (0, 0, 0, 0)) -> pa.Table:
    """answers, in the order of the parcels, as rows like those of table."""
    asked, k = table["items"].combine_chunks(), table.num_rows
    fields = [asked.flatten().field("block"), *(pa.array([a[i] if i < len(a) else None for a in answers], pa.binary()) for i in range(4))]
    ends = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())]).astype(np.int32)
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_ANSWER.value_type)), type=_ANSWER)
    return pa.table([table["shard"].combine_chunks(), rows, *(pa.array([x] * k, pa.int64()) for x in sums)], names=["shard", "items", "n", "v", "n1", "n2"])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _ask_words(blocks: DataFrame, shards: int) -> DataFrame:
    span = _span(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row)
                words = b.vocabulary.view(np.uint64)
                counts = np.bincount(b.tokens[b.learns], minlength=len(words))
                # sorted hashes fall into rising shards
                edge = np.searchsorted(((words >> W.U(32)) * W.U(shards) >> W.U(32)).astype(np.int64), np.arange(shards + 1))
                yield _ask_rows(row["block"], [(s, [_pack(words[x:y]), _pack(counts[x:y])]) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x], span)

    return blocks.mapInArrow(run, ASKED)


def _say_words(asked: DataFrame, shards: int) -> DataFrame:
    """Ids (rank * shards + shard of the words seen in training, frequent ones first) and counts, in the order asked; totals in every row."""

    def run(table: pa.Table) -> pa.Table:
        shard, items = table["shard"][0].as_py(), _items(table)
        hashes = [_unpack(i["a"]).view(np.uint64) for i in items]
        words, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, np.concatenate([_unpack(i["b"]) for i in items]), len(words)).astype(np.int64)
        seen = total > 0
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
        ids = np.where(seen, rank * shards + shard, _NONE)
        cut = np.cumsum([0] + [len(x) for x in hashes])
        said = [which[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        sums = (int(total.sum()), int(seen.sum()), int((total == 1).sum()), int((total == 2).sum()))
        return _replies(table, [(_pack(ids[w]), _pack(total[w])) for w in said], sums)

    return asked.groupBy("shard").applyInArrow(run, SAID)


class Grams:
    """What a block asks of a level's shards, in their order: its different grams (context, word), and its known contexts.

    A context's grams are dealt over parts shards by their word. Where a context has
    several parts, or no gram of a known word, it also asks every part with the word
    that stands for none, so that all its successors are counted.
    """

    def __init__(self, context: np.ndarray, known: np.ndarray, b: Block, ids: np.ndarray, counts: np.ndarray, n: int, shards: int) -> None:
        self.ids, self.counts = ids, counts
        self.ok = known & (b.counts[b.tokens] > 0)
        key = context[self.ok].astype(np.uint64)
        key <<= W.U(32)
        key |= b.tokens[self.ok].astype(np.uint64)
        unique, which = np.unique(key, return_inverse=True)
        del key
        self.different, self.which = len(unique), which.astype(np.int32)
        v, w = (unique >> W.U(32)).astype(np.int64), (unique & W.U(0xFFFFFFFF)).astype(np.int64)
        parts = np.minimum(1 + counts * shards // max(n, 1), shards)
        alone = (parts > 1) | (np.bincount(v, minlength=len(ids)) == 0)
        more = np.flatnonzero((np.bincount(context[known], minlength=len(ids)) > 0) & alone)
        extra = np.repeat(more, parts[more])
        part = np.arange(len(extra)) - np.repeat(np.cumsum(parts[more]) - parts[more], parts[more])
        sub = np.concatenate([(W.mix(b.word_ids[w].astype(np.uint64)) % parts[v].astype(np.uint64)).astype(np.int64), part])
        self.v, second = np.concatenate([v, extra]), np.concatenate([b.word_ids[w], np.full(len(extra), _NONE)])
        count = np.bincount(self.which[b.learns[self.ok]], minlength=len(self.v))
        shard = ((W.mix(ids[self.v].astype(np.uint64) + W.U(1)) % W.U(shards)).astype(np.int64) + sub) % shards
        by_context = np.argsort(self.v, kind="stable")
        self.order = by_context[np.argsort(shard[by_context].astype(np.int16 if shards < 1 << 15 else np.int64), kind="stable")]
        self.shard, self.v, self.second, self.count = (x[self.order] for x in (shard, self.v, second, count))
        new = np.concatenate([[True], (self.v[1:] != self.v[:-1]) | (self.shard[1:] != self.shard[:-1])]) if len(self.v) else np.zeros(0, bool)
        self.head = np.flatnonzero(new)

    def parcels(self, shards: int) -> list[tuple[int, list[bytes]]]:
        """Contexts, how many grams each has, how often they occur, and the words and counts of the grams, by shard."""
        sizes = np.diff(np.append(self.head, len(self.v)))
        edge = np.searchsorted(self.shard, np.arange(shards + 1))
        heads = np.searchsorted(self.head, edge)
        out = []
        for s in range(shards):
            x, y = edge[s], edge[s + 1]
            if y > x:
                c = self.v[self.head[heads[s] : heads[s + 1]]]
                out.append((s, [_pack_rising(self.ids[c]), _pack(sizes[heads[s] : heads[s + 1]]), _pack(self.counts[c]), _pack(self.second[x:y]), _pack(self.count[x:y])]))
        return out

    def dealt(self, values: np.ndarray) -> np.ndarray:
        """Values in the order asked, as one for each different gram."""
        out = np.empty(len(self.v), values.dtype)
        out[self.order] = values
        return out[: self.different]

    def followers(self, values: np.ndarray) -> np.ndarray:
        """Followers by context, over the shards it is dealt to."""
        return np.bincount(self.v[self.head], values, len(self.ids)).astype(np.int64)


def _pairs(b: Block, n: int, shards: int) -> tuple[np.ndarray, Grams]:
    """The word before each token, and the block's word pairs; a document starts after an end."""
    before = np.empty_like(b.tokens)
    before[1:] = b.tokens[:-1]
    before[b.bounds[:-1]] = b.tokens[b.bounds[1:] - 1]
    return before, Grams(before, b.counts[before] > 0, b, b.word_ids, b.counts, n, shards)


def _triples(b: Block, pairs: Grams, items: list[dict], n: int, shards: int) -> tuple[np.ndarray, np.ndarray, Grams]:
    """The word pair before each token, whether it is a context, and the block's grams of three; a document's first token has none.

    items: the answers to pairs, which say how often each occurs and which node it is.
    """
    count = _joined(items, "z")
    ids = np.zeros(len(count), np.int64)
    ids[count >= LEAST] = _joined(items, "u", _unpack_rising)
    count, ids = pairs.dealt(count), pairs.dealt(ids)
    before = np.full(len(b.tokens), -1, np.int32)
    before[1:][pairs.ok[:-1]] = pairs.which[: np.count_nonzero(pairs.ok[:-1])]
    before[b.bounds[:-1]] = -1
    known = (before >= 0) & (np.append(count, 0)[before] >= LEAST)
    before[~known] = 0
    return before, known, Grams(before, known, b, ids, count, n, shards)


def _ask_pairs(state: DataFrame, n: int, shards: int) -> DataFrame:
    span = _span(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _ask_rows(row["block"], _pairs(Block(row), n, shards)[1].parcels(shards), span)

    return state.mapInArrow(run, ASKED)


def answer_grams(asked: list[tuple[np.ndarray, ...]], step: float, shard: int = 0, shards: int = 1) -> list[tuple[np.ndarray, ...]]:
    """Build a shard's level from training counts and answer every parcel (contexts, sizes, occurrences, words, counts).

    An answer is (followers by context, codes, counts and places of its grams); a
    gram's place numbers the node all over the level.
    """
    contexts, context = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    often = np.zeros(len(contexts), np.int64)
    often[context] = np.concatenate([a[2] for a in asked])
    words, word = np.unique(np.concatenate([a[3] for a in asked]), return_inverse=True)
    counts = np.concatenate([a[4] for a in asked])
    key = np.repeat(context, np.concatenate([a[1] for a in asked])).astype(np.uint64) << W.U(32) | word.astype(np.uint64)
    unique, which = np.unique(key[counts > 0], return_inverse=True)
    total = np.bincount(which, counts[counts > 0], len(unique)).astype(np.int64)
    at = (unique >> W.U(32)).astype(np.int64)
    level = Level(contexts[at], words[(unique & W.U(0xFFFFFFFF)).astype(np.int64)], quantise((total - DISCOUNT) / often[at], step))
    out = []
    with tempfile.TemporaryDirectory() as folder:
        level.save(os.path.join(folder, "level"))
        for c, s, _, w, _ in asked:
            ranges = level.ranges(c)
            place = level.place(*(np.repeat(r, s) for r in ranges), w)
            hit = place >= 0
            codes, sums = np.zeros(len(w), np.uint8), np.zeros(len(w), np.int64)
            codes[hit], sums[hit] = level.codes[place[hit]], total[place[hit]]
            out.append((ranges[1] - ranges[0], codes, sums, place * shards + shard))
        del level
    return out


def _say_grams(asked: DataFrame, step: float, shards: int, nodes: bool) -> DataFrame:
    """Followers and codes; where nodes have children, counts, and ids of those that occur often enough."""

    def run(table: pa.Table) -> pa.Table:
        said = answer_grams([(_unpack_rising(i["a"]), *(_unpack(i[c]) for c in "bcde")) for i in _items(table)], step, table["shard"][0].as_py(), shards)
        return _replies(table, [(_pack(f), _pack(c), *((_pack(k), _pack_rising(at[k >= LEAST])) if nodes else ())) for f, c, k, at in said])

    return asked.groupBy("shard").applyInArrow(run, SAID)


STATE = "block long, doc_ids binary, train binary, bounds binary, tokens binary, word_ids binary, counts binary"
def _sorted_items(right: pa.Table) -> list[dict]:
    return sorted(_items(right), key=lambda i: i["shard"])


def _joined(items: list[dict], field: str, unpack: Callable[[bytes], np.ndarray] = _unpack) -> np.ndarray:
    parts = [unpack(i[field]) for i in items]
    return np.concatenate(parts) if parts else unpack(_pack(np.zeros(0)))


def _codes(raw: bytes) -> np.ndarray:
    """Codes as they travel."""
    return _unpack(raw).astype(np.uint8)


def _learn_words(blocks: DataFrame, back: DataFrame) -> DataFrame:
    """Blocks with the id and count of each of their words instead of hashes, and words numbered by id: frequent ones first, unknown ones last."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items = _sorted_items(right)
        ids, counts = _joined(items, "x"), _joined(items, "y")
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        tokens = number[_unpack(left["tokens"][0].as_py())]
        new = [pa.array([_pack(x)], pa.binary()) for x in (tokens, ids[order], counts[order])]
        return pa.table([left[c].combine_chunks() for c in ("block", *_BLOCK[:-1])] + new, names=["block", *_BLOCK, "word_ids", "counts"])

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, STATE)


def _row(left: pa.Table) -> dict:
    return {c: left[c][0].as_py() for c in left.schema.names}


def _ask_triples(state: DataFrame, back: DataFrame, n: int, shards: int) -> DataFrame:
    """Parcels of grams of three, once a block has heard of its pairs."""
    span = _span(shards)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(_row(left))
        _, pairs = _pairs(b, n, shards)
        *_, triples = _triples(b, pairs, _sorted_items(right), n, shards)
        return pa.Table.from_batches([_ask_rows(left["block"][0].as_py(), triples.parcels(shards), span)])

    return state.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, ASKED)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(state: DataFrame, back: list[DataFrame], n: int, v: int, rest: float, shards: int) -> DataFrame:
    """back: the answers to orders 2 and, maybe, 3."""
    table = probabilities(step_for(n))

    def mixed(grams: Grams, context: np.ndarray, known: np.ndarray, items: list[dict], lower: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of all tokens: discounted ones and the share left for the lower order."""
        own = np.zeros(len(lower))
        own[grams.ok] = table[grams.dealt(_joined(items, "y", _codes))][grams.which]
        left = DISCOUNT * grams.followers(_joined(items, "x")) / np.maximum(grams.counts, 1)
        own += left[context] * lower
        return np.where(known, own, lower)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, answers = Block(_row(left)), _items(right)
        by_order = [sorted((i for i in answers if i["order"] == k), key=lambda i: i["shard"]) for k in (2, 3)]
        base = np.log10((b.counts + 0.5) / (n + 0.5 * (v + 1)))
        p = (np.where(b.counts > 0, b.counts - rest, rest * v + 0.5) / (n + 0.5))[b.tokens]
        before, pairs = _pairs(b, n, shards)
        p = mixed(pairs, before, b.counts[before] > 0, by_order[0], p)
        if by_order[1]:
            before, known, triples = _triples(b, pairs, by_order[0], n, shards)
            p = mixed(triples, before, known, by_order[1], p)
        sums = [np.add.reduceat(x, b.bounds[:-1]) for x in (base[b.tokens], np.log10(p), (b.counts[b.tokens] > 0).astype(np.int64))]
        docs = len(b.train)
        return pa.table([pa.array(b.ids, pa.int64(), mask=b.no_id.astype(bool)), pa.array(~b.train), pa.array(np.diff(b.bounds)), pa.array(sums[2]), pa.array(np.full(docs, n, np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=[x.split()[0] for x in SCORES.split(", ")])

    def marked(answers: DataFrame, k: int) -> DataFrame:
        return answers.withColumn("items", F.transform("items", lambda i: i.withField("order", F.lit(k))))

    every = marked(back[0], 2) if len(back) == 1 else marked(back[0], 2).unionByName(marked(back[1], 3))
    return state.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, SCORES)


def score(df: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS, order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train marks the rows the model learns from; where it is null the row is one of
    them. Tokens are words (runs of non-white-space, A-Z as a-z) and an end; null
    texts count as empty and are an end alone. base_score sums log10((c + 0.5) / (N +
    0.5 * (V + 1))); score is the log10 probability under grams of up to order (2 or
    3) tokens. doc_id is integral and only carried, so repeated and null ones are
    rows of their own. A text of any length is scored whole. Only text, doc_id and
    train are read, so other columns cannot clash. Without training rows every token
    is unknown; an empty table gives an empty result.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    stages = Stages(df.sparkSession, "lm")
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).alias("text"))
    numbered = _blocks(rows).withColumn("block", F.monotonically_increasing_id())
    state = stages.save(numbered.select("block", *_BLOCK, "vocabulary", "n_tokens"), "blocks")
    tokens, blocks = state.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    shards = max(1, math.ceil((tokens or 0) / shard_tokens))
    state = state.drop("n_tokens")

    def round_(asked: DataFrame, say: str, answer: object) -> DataFrame:
        return stages.save(answer(_deliver(asked, shards, blocks)), say)  # type: ignore[operator]

    words = round_(_ask_words(state, shards), "words", lambda a: _say_words(a, shards))
    sums = words.groupBy("shard").agg(*(F.max(c).alias(c) for c in ("n", "v", "n1", "n2"))).agg(*(F.sum(c) for c in ("n", "v", "n1", "n2"))).first()
    n, v, n1, n2 = (int(x or 0) for x in sums)
    rest = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    step, done = step_for(n), words
    state = stages.save(_learn_words(state, _return(words, shards, blocks)), "known")
    stages.drop(done)
    pairs = round_(_ask_pairs(state, n, shards), "pairs", lambda a: _say_grams(a, step, shards, order > 2))
    back = [_return(pairs, shards, blocks)]
    if order > 2:
        asked = stages.save(_ask_triples(state, back[0], n, shards), "asked")  # frees one exchange before the next
        triples = round_(asked, "triples", lambda a: _say_grams(a, step, shards, False))
        stages.drop(asked)
        back.append(_return(triples, shards, blocks))
    return _score(state, back, n, v, rest, shards)
