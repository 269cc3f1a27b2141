"""Evaluating readings against labels, merging two readers, and reports."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import metrics, pairing

REPORT_VERSION = "1.0"


def outcomes(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(image, session, error, seconds, outcome) for labels (image, session, tags) and predictions (image, tags, timings_ms, error).

    A labelled photo without a prediction was read without a tag.
    """
    tags = F.coalesce("p.tags", F.array().cast(predictions.schema["tags"].dataType))
    joined = labels.alias("l").join(predictions.alias("p"), "image", "left")
    seconds = F.aggregate(F.coalesce(F.map_values("p.timings_ms"), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x) / 1000
    return joined.select("image", "l.session", "p.error", seconds.alias("seconds"), pairing.paired(F.col("l.tags"), tags).alias("outcome"))


def evaluate(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts and rates in total and by session."""
    return metrics.summarise(outcomes(labels, predictions))


def merge_readers(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Rows to check from one or two readers' (image, session, tags): image, session, row_no, text, tag_id, ai_1, ai_2, priority.

    Priority: 0 readers disagree or a tag is of the second alone (one reader: not
    accepted), 1 nothing found, 2 agreed but unsure, 3 fine. Unreadable text is ?.
    """
    shown = lambda t: F.coalesce(t, F.lit("?"))
    unsure = lambda t: t["status"] != "accepted"
    text = lambda c: F.coalesce(c, F.lit(""))

    def row(a: Any, ai_1: Any, ai_2: Any, priority: Any) -> Any:
        return F.struct(shown(a["text"]).alias("text"), text(a["tag_id"]).alias("tag_id"), ai_1.alias("ai_1"), ai_2.alias("ai_2"), priority.cast("int").alias("priority"))

    if second is None:
        both = first.withColumn("rows", F.transform("tags", lambda t: row(t, shown(t["text"]), F.lit(""), F.when(unsure(t), 0).otherwise(3))))
    else:
        joined = first.join(second.select("image", F.col("tags").alias("tags2")), "image", "left")
        empty = F.array().cast(second.schema["tags"].dataType)
        joined = joined.withColumn("o", pairing.paired(F.col("tags"), F.coalesce("tags2", empty)))

        def pair(p: Any) -> Any:
            ai_1 = shown(p["label"]["text"])
            ai_2 = F.when(p["prediction"].isNull(), "").otherwise(shown(p["prediction"]["text"]))
            return row(p["label"], ai_1, ai_2, F.when(ai_1 != ai_2, 0).when(unsure(p["label"]), 2).otherwise(3))

        extra = F.transform("o.invented", lambda t: row(t, F.lit(""), shown(t["text"]), F.lit(0)))
        both = joined.withColumn("rows", F.concat(F.transform("o.pairs", pair), extra))
    nothing = F.array(F.struct(F.lit("-").alias("text"), F.lit("").alias("tag_id"), F.lit("").alias("ai_1"), F.lit("").alias("ai_2"), F.lit(1).alias("priority")))
    rows = F.when(F.size("rows") > 0, F.col("rows")).otherwise(nothing)
    return both.select("image", "session", F.posexplode(rows).alias("row_no", "r")).select("image", "session", "row_no", "r.*")


def page_order(rows: DataFrame) -> DataFrame:
    """rows (image, row_no, priority) in review order: photos by their most urgent row, then by first row; a photo stays together.

    The order is total, so the window over a photo is the only grouping; the final
    sort is for the sink.
    """
    photo = Window.partitionBy("image")
    return rows.withColumn("photo_priority", F.min("priority").over(photo)).orderBy("photo_priority", "image", "row_no")


def report(total: dict[str, Any], sessions: list[dict[str, Any]], **run: Any) -> dict[str, Any]:
    """A report document from summary rows; rates to 4 decimals as Python rounds."""
    numbers = {k: round(v, 4) if isinstance(v, float) else v for k, v in total.items() if k not in ("session", "total", "seconds")}
    numbers["seconds_per_photo"] = round(total["seconds_per_photo"], 2)
    by = {s["session"]: {"photos": s["photos"], "readable_tags": s["readable_tags"], "exact_match_rate": round(s["exact_match_rate"], 4), "silent_errors": s["silent_errors"]} for s in sorted(sessions, key=lambda s: s["session"])}
    read = total["photos"] - total["failed_photos"]
    price = run.get("price_per_million_tokens")
    cost = None
    if price and read:
        cost = round((run["tokens"]["input"] * price["input"] + run["tokens"]["output"] * price["output"]) / 1e6 / read * 1000, 2)
    return {"report_version": REPORT_VERSION, **run, "metrics": numbers | {"sessions": by}, "cost_per_1000_photos_usd": cost}


def report_stem(*parts: str) -> str:
    """A file name stem: lower-case words joined by underscores, other characters as dashes."""
    return "_".join(re.sub(r"[^a-z0-9.-]+", "-", p.lower()).strip("-") for p in parts if p)


def markdown(document: dict[str, Any]) -> str:
    """A report as Markdown; texts of tags never appear in it."""
    m = document["metrics"]
    lines = [f"# Evaluation: {document.get('dataset', '')}", "", "| Metric | Value |", "| --- | --- |"]
    lines += [f"| {k.replace('_', ' ')} | {v:.2%} |" if k.endswith(("rate", "share")) else f"| {k.replace('_', ' ')} | {v} |" for k, v in m.items() if k != "sessions"]
    cost = document.get("cost_per_1000_photos_usd")
    lines.append(f"| cost per 1,000 photos | {'unknown' if cost is None else f'${cost:.2f}'} |")
    if len(m["sessions"]) > 1:
        lines += ["", "| Session | Photos | Readable | Exact | Silent errors |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {s or '-'} | {v['photos']} | {v['readable_tags']} | {v['exact_match_rate']:.1%} | {v['silent_errors']} |" for s, v in m["sessions"].items()]
    return "\n".join(lines) + "\n"


def save_report(document: dict[str, Any], folder: str, stem: str) -> None:
    """Write stem.json and stem.md."""
    for suffix, body in (("json", json.dumps(document, indent=2, ensure_ascii=False, allow_nan=False) + "\n"), ("md", markdown(document))):
        with open(f"{folder}/{stem}.{suffix}", "w", encoding="utf-8") as out:
            out.write(body)
