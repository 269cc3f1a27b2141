"""From raw documents to packed sequences, in stages that are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exactdup, mixing, neardup, packing, toxicity
from lectern.llm.shared import Stages

#: Largest repetition of a source in the mixture, relative to the least repeated one.
REPETITION = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under a half; labels of fold 0 stay out of training.

    Null and empty texts score the model's leak, which a corpus with labels of both
    kinds keeps under a half; without toxic labels every document stays. Repeated rows
    fare alike; texts of any length are judged whole; an empty table stays empty;
    columns are as they were.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id.

    Null counts as empty; a null doc_id stays only where its text has no other; rows
    equal in all columns count once; an empty table stays empty; columns are as they
    were.
    """
    return exactdup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id: 5-word shingles, similarity 0.8.

    Null and empty texts and rows without a doc_id belong to no group and stay; rows
    that repeat a doc_id count as one document and fare alike; an empty table stays
    empty; columns are as they were.
    """
    return neardup.near_dedup(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated up to REPETITION times, in permuted blocks.

    A null source is a source of its own; null and empty texts have no tokens and are
    read once in each whole pass; rows that repeat a doc_id in a source fare alike; an
    empty table stays empty; columns are as they were.
    """
    return mixing.mix(docs, limit=REPETITION)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their ids, each a sequence of its own.

    A null or empty text is the end id alone; each row is a document, repeated rows
    too; an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again by the next."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stages.save(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
