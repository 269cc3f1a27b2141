"""Temperature mixing of sources, realised as budgeted block permutations.

Target weights are source token shares raised to an exponent and normalised; the
exponent is bisected to a target entropy, or to the flattest weights within a
limit on repetition. Each source is then read in a permuted order of blocks:
whole passes, and a last pass up to the block and document where its token
budget ends. That end is one row per source, so texts are counted once and travel
once, when the mixture deals whole blocks to partitions and puts them in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import Stages

#: Bytes of a table of sources that tasks may each be sent; a larger one is joined by shuffle.
SENT_BYTES = 16 << 20
BLOCK_DOCS = 1024
LIMIT = 2.0
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Plan:
    """exponent, token budget, tokens of all sources, and the sum of the raised shares."""

    exponent: float
    budget: float
    tokens: int
    norm: float

    def weight(self, tokens: int) -> float:
        """The weight of a source of so many tokens."""
        return (tokens / self.tokens) ** self.exponent / self.norm if tokens else 0.0


def entropy(p: list[tuple[float, int]]) -> float:
    """Of weights and how many sources have each, in nats."""
    return -sum(x * math.log(x) * k for x, k in p if x)


def plan(sources: dict[int, int], limit: float = LIMIT, target_entropy: float | None = None, budget: int | None = None) -> Plan:
    """Exponent and budget from how many sources have how many tokens.

    Without a budget, the smallest one with which no source is cut, so a source's
    repetition is its weight over share relative to the least; limit bounds the
    largest repetition. With target_entropy the exponent meets that instead (the
    nearest one in [0, 1] where it is out of reach). Sources of equal size weigh the
    same, so what grows with the corpus is at most the number of different sizes.
    """
    sizes = sorted((t, k) for t, k in sources.items() if t)
    total = sum(t * k for t, k in sizes)

    def at(e: float) -> Plan:
        norm = sum((t / total) ** e * k for t, k in sizes)
        made = Plan(e, 0.0, total, norm)
        return Plan(e, budget if budget is not None else max(t / made.weight(t) for t, _ in sizes), total, norm)

    def low(e: float) -> bool:
        """Whether the exponent is too low: weights flatter than asked for."""
        made = at(e)
        if target_entropy is not None:
            return entropy([(made.weight(t), k) for t, k in sizes]) > target_entropy
        return max(made.budget * made.weight(t) / t for t, _ in sizes) > limit * (1 + 1e-12)

    if not sizes:
        return Plan(0.0, budget or 0, 0, 1.0)
    a, b = 0.0, 1.0
    if not low(a):
        b = a
    for _ in range(60):
        if b - a <= 1e-12:
            break
        a, b = ((a + b) / 2, b) if low((a + b) / 2) else (a, (a + b) / 2)
    return at(b)


def n_tokens(text: str) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _before(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums over the rows of the same by that come earlier in order.

    The first column of order is a hash: its high byte splits each group into ranges,
    whose sums run over a few hundred rows; inside a range rows meet in one task.
    """
    rows = rows.withColumn("_range", F.shiftright(F.col(order[0]), 56))
    each = rows.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.struct(*by, "_range", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(n) for n in sums)).alias("_e"))
    rows = rows.join(each, [F.col(c).eqNullSafe(F.col(f"_e.{c}")) for c in (*by, "_range")])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({n: F.col(f"_e.{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).drop("_e", "_range")


@dataclass(frozen=True)
class Mixture:
    """slim (source, id, tokens), sources, blocks and cuts of a mixture, all of them tables, and its plan."""

    plan: Plan
    slim: DataFrame
    sources: DataFrame
    blocks: DataFrame
    cuts: DataFrame
    seed: int

    def placed(self, rows: DataFrame, source: str, doc_id: str) -> DataFrame:
        """rows with _weight, _block, _order and _key (their places in a pass) and _copies (how often the mixture reads them)."""
        rows = rows.join(_sent(self.sources, "_p"), F.col(source).eqNullSafe(F.col("_p.source")), "left")
        rows = rows.withColumn("_block", F.pmod(_hash(self.seed, F.col(doc_id)), F.col("_p.blocks"))).withColumn("_order", _hash(self.seed + 1, F.col(source), F.col("_block"))).withColumn("_key", _hash(self.seed + 2, F.col(doc_id)))
        rows = rows.join(_sent(self.cuts, "_c"), F.col(source).eqNullSafe(F.col("_c.source")), "left")
        here, there = F.struct(F.col("_order"), F.col("_block")), F.struct(F.col("_c._order"), F.col("_c._block"))
        chosen = F.when(F.col("_p.rest") == 0, False).when(F.col("_c").isNull(), True).when(here == there, F.coalesce(F.col("_key") <= F.col("_c.last"), F.lit(False))).otherwise(here < there)
        return rows.withColumn("_copies", F.col("_p.passes") + chosen.cast("long")).withColumn("_weight", F.col("_p.weight")).drop("_p", "_c")


def _sent(table: DataFrame, name: str) -> DataFrame:
    """table as one struct column; sent to all tasks if its checked size allows."""
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    packed = table.select(F.struct(*table.columns).alias(name))
    return F.broadcast(packed) if size <= SENT_BYTES else packed


def prepare(df: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", limit: float = LIMIT, target_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 7) -> Mixture:
    """Count the words of every text once, and find weights, budgets, blocks and where each source's last pass ends.

    The last, partial pass over a source takes blocks in the order of a seeded hash
    and documents within them likewise, as far as whole documents fit its budget.
    """
    stages = Stages(df.sparkSession, "mix")
    slim = stages.save(df.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), n_tokens(text).alias("tokens")), "tokens")
    per = stages.save(slim.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "totals")
    made = plan({r["t"]: r["n"] for r in per.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}, limit, target_entropy, budget)
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(made.tokens, 1))), F.lit(made.exponent)) / F.lit(made.norm)).otherwise(0.0)
    share = F.floor(F.lit(float(made.budget)) * weight + 1e-6).cast("long")
    given = F.when(F.col("t") == 0, 0).otherwise(share if budget is not None else F.greatest(share, "t"))
    sources = per.select("source", weight.alias("weight"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).alias("blocks"), "t", given.alias("given"))
    sources = sources.select("source", "weight", "blocks", "given", F.when(F.col("t") > 0, F.floor(F.col("given") / F.greatest("t", F.lit(1)))).otherwise(1).cast("long").alias("passes"), F.when(F.col("t") > 0, F.col("given") % F.greatest("t", F.lit(1))).otherwise(0).cast("long").alias("rest"))
    sources = stages.save(sources, "sources")
    none = df.sparkSession.createDataFrame([], f"source {df.schema[source].dataType.simpleString()}, _order long, _block long, last long")
    mixture = Mixture(made, slim, sources, none, none, seed)
    placed = mixture.placed(slim, "source", "id").select("source", "id", "tokens", "_block", "_order", "_key")
    sums = placed.groupBy("source", "_block", "_order").agg(F.sum("tokens").alias("tokens"))
    blocks = stages.save(_before(sums, ["source"], ["_order", "_block"], {"before": F.col("tokens"), "block_rank": F.lit(1)}), "blocks")
    split = blocks.join(_sent(sources.select("source", "rest"), "_p"), F.col("source").eqNullSafe(F.col("_p.source"))).where("_p.rest > 0 AND before <= _p.rest AND before + tokens > _p.rest")
    split = split.groupBy("source").agg(F.min_by(F.struct("_order", "_block", (F.col("_p.rest") - F.col("before")).alias("left")), F.struct("_order", "_block")).alias("x")).select("source", "x.*")
    split = stages.save(split, "split")
    inner = placed.join(_sent(split, "_c"), F.col("source").eqNullSafe(F.col("_c.source")) & (F.col("_order") == F.col("_c._order")) & (F.col("_block") == F.col("_c._block")))
    docs = inner.groupBy("source", "id", "_key", F.col("_c.left").alias("left")).agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("source").orderBy("_key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one block of each source
    fits = docs.withColumn("sum", F.sum("tokens").over(running)).where("sum <= left").groupBy(F.col("source").alias("s")).agg(F.max("_key").alias("last"))
    cuts = stages.save(split.join(fits, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "_order", "_block", "last"), "cuts")
    return Mixture(made, slim, sources, blocks, cuts, seed)


def schedule(df: DataFrame, **how: object) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, exponent, weight, block, copies, block_rank, place.

    copies says how often the mixture reads the row, once in each of as many passes;
    block_rank is the place of its block in the source's permutation and place that of
    the row in its block, both from 0. A null source is a source of its own; rows that
    repeat a doc_id in a source share its fate; null and empty texts have no tokens
    and are read once per whole pass; a text of any length counts whole; any number of
    sources will do. An empty table gives an empty schedule. Only the source, text and
    id columns are read, so other columns cannot clash.
    """
    made = prepare(df, **how)  # type: ignore[arg-type]
    rows = made.placed(made.slim, "source", "id")
    ranks = made.blocks.select(F.struct("source", "_block", "block_rank").alias("_b"))
    rows = rows.join(ranks, F.col("source").eqNullSafe(F.col("_b.source")) & (F.col("_block") == F.col("_b._block")), "left")
    place = F.row_number().over(Window.partitionBy("source", "_block").orderBy("_key", "id", "tokens")) - 1
    return rows.select(
        F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.lit(made.plan.exponent).alias("exponent"), F.col("_weight").alias("weight"),
        F.col("_block").alias("block"), F.col("_copies").alias("copies"), F.col("_b.block_rank").cast("long").alias("block_rank"), place.cast("long").alias("place"),
    )


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", **how: object) -> DataFrame:
    """The mixture: df's columns, each row as often as schedule() says, in permuted blocks.

    Whole blocks of one pass are dealt to partitions, which hold them in the order of
    a seeded hash over all sources and passes, their rows by another. The inputs that
    schedule() defines hold here too.
    """
    made = prepare(df, source=source, doc_id=doc_id, **how)  # type: ignore[arg-type]
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("id"))
    rows = made.placed(whole, "source", "id").where("_copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    turn = _hash(made.seed + 3, F.col("_order"), F.col("_block"), F.col("_pass"))
    return rows.withColumn("_turn", turn).repartition("_turn").sortWithinPartitions("_turn", "_key").select("row.*")
