"""Connected components of edge tables, without ever collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stages


def components(edges: DataFrame, stages: Stages, most: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b), for every id on an edge.

    Each round takes the smallest label among neighbours and then the label of that
    label, so long chains shrink fast; rounds are written tables. Edges whose ends
    agree already can still carry a smaller label on, so all of them stay; callers
    contract what earlier edges joined.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stages.save(both, "links")
    labels = stages.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        nxt = stages.save(step.join(jump, "new", "left").select("id", F.col("comp").alias("was"), F.least("new", "far").alias("comp")), "labels")
        done = nxt.where("was <> comp").isEmpty()
        stages.drop(labels)
        labels = nxt.drop("was")
        labels._stage_path = nxt._stage_path  # type: ignore[attr-defined]
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    stages.drop(both)
    return labels
