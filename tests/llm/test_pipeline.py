"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import collections
import math
import re

import corpus_pipeline
import public_tokenizers
from lectern.llm import packing, toxicity
from lectern.llm import wordvec as W
from llm.test_llm import brute_mixing, brute_near, by_id
from pyspark.sql import functions as F


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES:
        step(spark, tables[-1], data).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, clean, unique, single, mixed, packed = tables
    assert all(t.columns == columns for t in tables[:-1])

    rows = {t: [tuple(r) for r in frame.select("doc_id", "text").collect()] for t, frame in zip(("raw", "clean", "unique", "single", "mixed"), tables, strict=False)}
    gone = {i for i, _ in rows["raw"]} - {i for i, _ in rows["clean"]}
    insult = re.compile(r"\b(?:idiot|stupid|moron|trash|scum|loser|worthless|pathetic|disgusting|clown)\b", re.I)
    assert gone and sum(bool(insult.search(t)) for i, t in rows["raw"] if i in gone) >= 0.9 * len(gone)

    best = {}
    for i, t in rows["clean"]:
        best[t] = max(best.get(t, -1), i)
    assert sorted(rows["unique"]) == sorted((i, t) for t, i in best.items())

    ordered = sorted(rows["unique"])
    want = brute_near([t for _, t in ordered], 5, 80)
    assert sorted(i for i, _ in rows["single"]) == sorted(ordered[c][0] for k, (_, c) in enumerate(want) if c == k)

    counts = collections.Counter(i for i, _ in rows["mixed"])
    assert set(counts) == {i for i, _ in rows["single"]} and max(counts.values()) <= 2

    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lengths = collections.Counter((r["doc_id"], r["length"]) for r in packed.collect())
    expected = collections.Counter()
    for i, t in rows["mixed"]:
        expected.update((i, n) for n in packing.binary_pieces(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1))
    assert lengths == expected


def noisy_or(model, text):
    """A document's score, sentence by sentence."""
    known = dict(zip(model.words.astype("int64").tolist(), model.weights.tolist(), strict=True))
    clean = 1 - model.leak
    for sentence in re.split("[\n\r!.?]", text or ""):
        words = {W.hash_text(w, lower=True) for w in re.findall("[A-Za-z0-9\x80-\U0010ffff]+", sentence)}
        if words:
            clean *= 1 / (1 + math.exp(model.bias + sum(known.get(h, 0.0) for h in words)))
    return 1 - clean


def test_toxicity_and_mixing_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = by_id(toxicity.score(docs, model))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(model.words) and all(abs(got[i]["score"] - noisy_or(model, t)) < 1e-9 for i, t in texts.items())
    stays = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()}
    assert stays == {i for i in texts if got[i]["score"] < 0.5}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = brute_mixing(rows, 1024, corpus_pipeline.REPETITION)
    mixed = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, data).collect())
    assert mixed == {rows[i][0]: x[2] for i, x in want.items() if x[2]}


def test_awkward_documents(spark, data, tmp_path):
    """Nulls in any column, blank and very long texts, repeated rows and ids, and nothing at all, through every stage."""
    long = " ".join(f"w{i % 991}" for i in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (1, "seven eight nine", "en", "b", 5), (2, "one two three four five six", None, None, None),
        (3, None, None, None, None), (4, "", "en", "a", 0), (None, "one two three four five six seven", "en", "a", 1), (None, None, None, None, None), (5, long, "fr", "c", 9), (6, f"{long} more", "fr", "c", 9),
    ]
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, step in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{len(table)}"
            step(spark, docs, data).write.parquet(path)
            docs, before = spark.read.parquet(path), docs
            if name != "packing":
                assert docs.columns == before.columns
            if table and name == "exact dedup":
                assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in docs.collect()) == [(0, "one two t"), (1, "seven eig"), (2, "one two t"), (4, ""), (5, "w0 w1 w2 "), (6, "w0 w1 w2 ")]
            if table and name == "near dedup":
                assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 2, 4, 5]
        assert bool(docs.count()) == bool(table)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and len(by_id(out, "sequence_id")) == out.count()
    assert toxicity.MAX_DOCS > 0
