"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition yields a run of (digest, best id, count) sorted by digest.
Rounds then exchange the runs of fan_in neighbours, shard by shard of the digest
space, order them by digest again and merge equal neighbours in one pass, keeping
one verified entry per digest, until one run is left; so no exchange ever holds
more than one entry per run of a text, however many copies there are. The best id
is a struct, which Spark aggregates over sorted rows only: the sort and the merge
of every round stay in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 8
SHARDS = 4096


def runs_of(df: DataFrame) -> int:
    """How many runs the first level has: as the session's shuffles, 64 at least, a power of two."""
    return 1 << (max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()


def _entries(rows: DataFrame, runs: int, largest: bool) -> DataFrame:
    """Sorted runs of (run, shard, digest, size, proof, best, copies) from rows (digest, size, proof, order)."""
    best = F.max("order") if largest else F.min("order")
    return (
        rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int"))
        .withColumn("shard", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
        .groupBy("run", "shard", "digest", "size", "proof")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    )


def _order(doc_id: Column, largest: bool) -> Column:
    """What the best row has least (largest: most) of: a null id comes last."""
    return F.struct((doc_id.isNotNull() if largest else doc_id.isNull()).alias("late"), doc_id.alias("id"))


def _merge(runs: DataFrame, largest: bool) -> DataFrame:
    """One entry per (run, shard, digest); equal digests count as equal only with equal length and second digest."""
    best = F.max("best") if largest else F.min("best")
    return runs.repartition("run", "shard").groupBy("run", "shard", "digest", "size", "proof").agg(best.alias("best"), F.sum("copies").alias("copies"))


def merge_runs(entries: DataFrame, runs: int, fan_in: int = FAN_IN, largest: bool = False) -> DataFrame:
    """Merge (run, shard, digest, size, proof, best, copies) in rounds of fan_in runs to one run; best is a struct."""
    left = runs
    while left > 1:
        left = math.ceil(left / fan_in)
        entries = _merge(entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), largest)
    return entries.drop("run")


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the
    row with the smallest (keep="largest": the largest) doc_id stays. Of rows that
    repeat both text and doc_id, each says kept, as each carries the id that stays.
    A null doc_id stays only where the whole group has no other. Other columns are
    not read. Entries merge on SHA-256, length and an independent 64-bit hash. Texts
    of any length count by these alone; an empty table gives an empty result.
    """
    largest, runs = keep == "largest", runs or runs_of(df)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
        F.octet_length(body).alias("size"),
        F.xxhash64(body).alias("proof"),
    )
    slim = rows.select("digest", "size", "proof", _order(F.col("doc_id"), largest).alias("order"))
    merged = merge_runs(_entries(slim, runs, largest), runs, fan_in, largest)
    groups = merged.where("copies > 1").select("digest", "size", "proof", F.col("best.id").alias("best"), "copies")
    return rows.join(groups, ["digest", "size", "proof"], "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("copies").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("best"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """df with one row per distinct text (null counts as empty), its columns as they were.

    The row with the smallest (keep="largest": the largest) doc_id stays, one with a
    null doc_id only where its group has no other; among rows that repeat text and
    doc_id the pick goes by a hash of the whole row, and of rows equal in all
    columns one stays. Texts of any length and extra columns travel once, after the
    survivors are known; an empty table gives an empty result.
    """
    body, largest = F.coalesce(F.col(text), F.lit("")), keep == "largest"
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    digest, row = F.sha2(body.cast("binary"), 256), F.xxhash64(*plain)
    order = F.struct(*(_order(F.col(doc_id), largest)[c].alias(c) for c in ("late", "id")), row.alias("row"))
    slim = df.select(digest.alias("digest"), F.octet_length(body).alias("size"), F.xxhash64(body).alias("proof"), order.alias("order"))
    runs = runs_of(df)
    merged = merge_runs(_entries(slim, runs, largest), runs, largest=largest)
    stays = merged.select("digest", F.col("best.row").alias("row"))
    rows = df.select(digest.alias("digest"), row.alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole"))
    once = rows.dropDuplicates(["digest", "row"])  # equal rows meet before they travel; copies of a text are dealt by their rows
    return once.join(stays, ["digest", "row"], "left_semi").select("whole.*")
