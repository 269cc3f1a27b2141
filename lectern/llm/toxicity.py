"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the words it holds, for or against; the document's is the noisy-or of the scores
of all its sentences and a leak. Labels exist only for documents: training
maximises their likelihood through the noisy-or, and the sentence scores it finds
point at the offending sentences. Executors count words and reduce the sample's
texts to bags of known words; the driver sees those bags and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as W
from lectern.llm.shared import Stages

#: Bounds of the training sample: documents of each class, and words with a weight on either side.
MAX_DOCS = 2000
MAX_WORDS = 256
#: A word gets a weight if it occurs in that many different sentences of samples of its class: at least MIN_SENTENCES, and MIN_SHARE by document; and if its classes differ by LEAST_CHI.
MIN_SENTENCES = 3
MIN_SHARE = 0.02
LEAST_CHI = 10.0
_END = np.zeros(256, bool)
_END[[10, 13, 33, 46, 63]] = True
SCHEMA = "score double, predicted int, sentences int, offending array<struct<start:long,end:long,score:double>>"


@dataclass(frozen=True)
class Model:
    """words: sorted word hashes; weights by word; bias of a sentence; leak: the score of a document without sentences."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


@dataclass(frozen=True)
class Bags:
    """Different sentences by document: (document, times) of each, and (sentence, word) of its known words."""

    document: np.ndarray
    times: np.ndarray
    sentence: np.ndarray
    word: np.ndarray


def _hits(buf: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, sentence, word index) of each known word, once a sentence; the sentence-end counts by byte; sentences by text."""
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(_END[buf], dtype=np.int32)])
    starts, stops, first = W.words(buf, off, W.NOT_ALNUM)
    owner, place = W.owner(first), ends[starts]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])]) if len(starts) else np.zeros(0, bool)
    count = np.bincount(owner[new], minlength=len(off) - 1)
    h = W.hashes(buf, starts, stops, lower=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & W.U(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(h & W.U(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(known, h[at]), max(len(known) - 1, 0))
    at, k = (at[ok], k[ok]) if len(known) and (ok := known[k] == h[at]) is not None else (at[:0], k[:0])
    rows = np.unique(np.stack([owner[at], place[at], k], 1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
    return rows[:, 0], rows[:, 1], rows[:, 2], ends, count


def _heads(text: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Where a (text, sentence) begins among sorted ones."""
    return np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])])) if len(text) else np.zeros(0, np.int64)


COUNTS = "word long, content long, n1 long, n0 long"


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, n1, n0, seen1, seen0): toxic and other documents that hold a word, and its different sentences in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for lo, hi, buf, off in W.slices(batch.column(1)):
                starts, stops, first = W.words(buf, off, W.NOT_ALNUM)
                if not len(starts):
                    continue
                word, index = np.unique(W.hashes(buf, starts, stops, lower=True), return_inverse=True)
                owner, bad = W.owner(first), toxic[lo:hi] == 1
                held = np.unique(owner * len(word) + index)
                ones = np.bincount(held % len(word), bad[held // len(word)], len(word)).astype(np.int64)
                n = np.bincount(held % len(word), minlength=len(word))
                head = _heads(owner, np.cumsum(_END[buf], dtype=np.int32)[starts])
                size = np.diff(np.append(head, len(starts)))
                content = np.repeat(np.add.reduceat(W.mix(word[index]), head), size)
                # copies of a sentence count once; the last bit tells the classes apart
                content = (content & ~W.U(1)) | bad[owner].astype(np.uint64)
                pairs = np.unique(np.stack([word[index], content], 1), axis=0)
                zero = np.zeros(len(pairs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([word, pairs[:, 0]]).astype(np.int64)), pa.concat_arrays([pa.nulls(len(word), pa.int64()), pa.array(pairs[:, 1].astype(np.int64))]), pa.array(np.concatenate([ones, zero])), pa.array(np.concatenate([n - ones, zero]))], names=["word", "content", "n1", "n0"])

    rows = sample.select("_toxic", "_text").mapInArrow(run, COUNTS).groupBy("word", "content").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odd = F.col("content").isNotNull() & (F.col("content").bitwiseAND(F.lit(1)) == 1)
    even = F.col("content").isNotNull() & (F.col("content").bitwiseAND(F.lit(1)) == 0)
    return rows.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(odd).alias("seen1"), F.count_if(even).alias("seen0"))


BAGS = "toxic int, sentences long, bags array<struct<words:array<int>,times:long>>"


def _reduce(sample: DataFrame, known: np.ndarray) -> DataFrame:
    """A row for each document: its label, its sentences, and the different sets of known words among them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BAGS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(1)):
                text, sentence, k, _, count = _hits(buf, off, known)
                head = _heads(text, sentence)
                found: list[dict[tuple, int]] = [{} for _ in range(hi - lo)]
                for a, b in zip(head.tolist(), np.append(head, len(text))[1:].tolist(), strict=True):
                    own, words = found[text[a]], tuple(k[a:b].tolist())
                    own[words] = own.get(words, 0) + 1
                bags = [[{"words": list(w), "times": n} for w, n in own.items()] for own in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int32()), pa.array(count.astype(np.int64)), pa.array(bags, schema.field(2).type)], schema=schema)

    return sample.select("_toxic", "_text").mapInArrow(run, BAGS)


def loss(x: np.ndarray, bags: Bags, toxic: np.ndarray, weight: np.ndarray, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the documents' labels under the noisy-or, and its gradient.

    x: weights by word, the sentence's bias, the logit of the leak.
    """
    n, total = len(toxic), weight.sum()
    z = x[-2] + np.bincount(bags.sentence, x[bags.word], len(bags.document))
    p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-x[-1]))
    log_clean = np.bincount(bags.document, -bags.times * np.logaddexp(0, z), n) + np.log1p(-leak)
    clean = np.minimum(np.exp(log_clean), 1 - 1e-9)
    value = -(weight * np.where(toxic > 0, np.log1p(-clean), log_clean)).sum() / total
    slope = weight * np.where(toxic > 0, -clean / (1 - clean), 1.0) / total  # of the log-likelihood, by log_clean
    dz = -p * bags.times * slope[bags.document]
    g = -np.concatenate([np.bincount(bags.word, dz[bags.sentence], len(x) - 2), [dz.sum(), -leak * slope.sum()]])
    g[:-2] += decay * x[:-2]
    return value + decay / 2 * float((x[:-2] ** 2).sum()), g


def fit(known: np.ndarray, start: np.ndarray, bags: Bags, toxic: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.1) -> Model:
    """Descend loss() from starting weights; weight: how many labelled documents each sample stands for."""
    x = np.concatenate([start, [-5.0, np.log(0.02 / 0.98)]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        _, g = loss(x, bags, toxic, weight)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return Model(known, x[:-2], float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def train(df: DataFrame, labels: DataFrame, train_on: Column | None = None, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Fit on at most max_docs labelled documents of each class, chosen by a hash of doc_id, their texts whole.

    A label null or outside 0 and 1 is none; a doc_id labelled twice counts as toxic
    if one label says so; of rows that repeat a doc_id the least text counts. Null
    texts count as empty. Without toxic labels the model scores every text 0.
    """
    stages = Stages(df.sparkSession, "toxic")
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_toxic"))
    if train_on is not None:
        marked = marked.withColumnRenamed("_id", doc_id).where(train_on).withColumnRenamed(doc_id, "_id")
    counts = {r[0]: r[1] for r in marked.groupBy("_toxic").count().collect()}
    parts = [marked.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(max_docs) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * max_docs rows
    texts = df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sample = stages.save(texts.join(chosen, "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")), "sample")
    size = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    if not size.get(1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    each = {c: counts[c] / size[c] for c in size}  # how many labelled documents a sample stands for
    t1, t0 = float(counts[1]), max(float(counts.get(0, 0)) if size.get(0) else 0.0, 1e-9)
    n1, n0 = F.col("n1") * each[1], F.col("n0") * each.get(0, 0.0)
    chi = (t1 + t0) * F.pow(n1 * (t0 - n0) - n0 * (t1 - n1), F.lit(2.0)) / F.greatest(t1 * t0 * (n1 + n0) * (t1 + t0 - n1 - n0), F.lit(1e-9))
    start = F.log((n1 + 0.5) / (n0 + 0.5) * (t0 / t1))
    words = _word_counts(sample).select("word", "seen1", "seen0", chi.alias("chi"), start.alias("start"), (n1 / t1 > n0 / t0).alias("bad")).where(F.col("chi") > LEAST_CHI)
    enough = lambda c: max(MIN_SENTENCES, MIN_SHARE * size.get(c, 0))
    sides = [words.where(F.col("bad") & (F.col("seen1") >= enough(1))), words.where(~F.col("bad") & (F.col("seen0") >= enough(0)))]
    best = [side.orderBy(F.desc("chi"), "word").limit(max_words).select("word", "start").toArrow() for side in sides]
    word = np.concatenate([t["word"].to_numpy() for t in best]).astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    known, start_at = word[order], np.concatenate([t["start"].to_numpy() for t in best])[order]
    rows = _reduce(sample, known).toArrow().to_pylist()
    stages.drop(sample)
    document, times, sentence, held = [], [], [], []
    for d, r in enumerate(sorted(rows, key=repr)):
        rest = r["sentences"] - sum(b["times"] for b in r["bags"])
        for b in [*r["bags"], *([{"words": [], "times": rest}] if rest else [])]:
            sentence += [len(document)] * len(b["words"])
            held += b["words"]
            document.append(d)
            times.append(b["times"])
    toxic = np.array([r["toxic"] for r in sorted(rows, key=repr)], np.int64)
    weight = np.where(toxic == 1, each[1], each.get(0, 0.0))
    return fit(known, start_at, Bags(*(np.array(x, np.int64) for x in (document, times, sentence, held))), toxic, weight)


def _scores(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document scores; by sentence with a known word: text, sentence, score; the sentence-end counts; sentences by text."""
    text, sentence, k, ends, count = _hits(buf, off, model.words)
    head = _heads(text, sentence)
    bag, place = text[head], sentence[head]
    z = (np.add.reduceat(model.weights[k], head) if len(head) else np.zeros(0)) + model.bias
    rest = count - np.bincount(bag, minlength=len(count))
    clean = np.bincount(bag, -np.logaddexp(0, z), len(count)) - rest * np.logaddexp(0, model.bias) * (len(model.words) > 0) + np.log1p(-model.leak)
    return np.clip(1 - np.exp(clean), 0.0, 1.0), bag, place, 1 / (1 + np.exp(-z)), ends, count


def drop_toxic(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df without the rows that score threshold or more; columns and other rows as they were.

    Null and empty texts score the leak; rows that repeat fare alike; a text of any
    length is scored whole; an empty table gives an empty one.
    """

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [_scores(model, buf, off)[0] for _, _, buf, off in W.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return df.where(judge(F.col(text)) < threshold)


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """One row per input row: the columns of keep, score, predicted, sentences and offending.

    offending: sentences whose own score reaches threshold, as code points [start,
    end) of the text. A null or empty text has no sentence and scores the leak; a
    text of any length is scored whole; rows that repeat score alike; an empty table
    gives an empty result. Only keep and text are read, so other columns cannot clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keep = list(keep)
    full = StructType([df.schema[c] for c in keep] + StructType.fromDDL(SCHEMA).fields)
    schema = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(len(keep))):
                n = hi - lo
                total, bag, sentence, p, ends, count = _scores(model, buf, off)
                spans: list[list[dict]] = [[] for _ in range(n)]
                cut = np.flatnonzero(_END[buf])
                for d, s, q in zip(bag[p >= threshold], sentence[p >= threshold], p[p >= threshold], strict=True):
                    a = max(off[d], cut[s - 1] + 1 if s else 0)
                    b = min(off[d + 1], cut[s] + 1 if s < len(cut) else len(buf))
                    points = lambda x, y: int(np.count_nonzero((buf[x:y] & 0xC0) != 0x80))
                    start = points(off[d], a)
                    spans[d].append({"start": start, "end": start + points(a, b), "score": float(q)})
                new = [pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(spans, schema.field(len(keep) + 3).type)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, n).cast(schema.field(i).type) for i in range(len(keep))] + new, schema=schema)

    return df.select(*keep, text).mapInArrow(run, full)
