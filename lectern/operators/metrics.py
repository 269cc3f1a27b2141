"""Accuracy, cost and regressions from outcomes, in one aggregation pass.

An outcome row is a photo: image, session, error (null if read), seconds, and
outcome as paired() returns it, with predictions of text, status and source.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = (
    "photos", "failed_photos", "readable_tags", "unreadable_tags", "predicted_tags", "accepted_tags", "review_tags",
    "unreadable_predictions", "fallback_tags", "exact_matches", "accepted_correct", "silent_errors", "missed_tags", "invented_tags", "edits", "characters",
)
# US dollars per million input and output tokens come with the price table of the caller.
PRICES = "model string, usd_in double, usd_out double"


def _count(items: Column, test: Any) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def _total(items: Column, value: Any) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0).cast("long"), lambda a, x: a + x)


def photo_counts(outcome: Column) -> dict[str, Column]:
    """Counts of one photo that was read."""
    pairs, invented = outcome["pairs"], outcome["invented"]
    found = F.filter(pairs, lambda p: p["prediction"].isNotNull())
    predictions = F.concat(F.transform(found, lambda p: p["prediction"]), invented)
    readable = F.filter(pairs, lambda p: p["label"]["text"].isNotNull())
    unreadable = F.filter(pairs, lambda p: p["label"]["text"].isNull())
    hit = F.filter(readable, lambda p: p["prediction"].isNotNull())
    accepted = lambda p: p["prediction"]["status"] == "accepted"
    right = lambda p: F.coalesce(p["prediction"]["text"] == p["label"]["text"], F.lit(False))
    return {
        "readable_tags": F.size(readable).cast("long"),
        "unreadable_tags": F.size(unreadable).cast("long"),
        "predicted_tags": F.size(predictions).cast("long"),
        "accepted_tags": _count(predictions, lambda t: t["status"] == "accepted"),
        "review_tags": _count(predictions, lambda t: t["status"] == "review"),
        "unreadable_predictions": _count(predictions, lambda t: t["status"] == "unreadable"),
        "fallback_tags": _count(predictions, lambda t: t["source"] == "fallback"),
        "exact_matches": _count(hit, right),
        "accepted_correct": _count(hit, lambda p: accepted(p) & right(p)),
        "silent_errors": _count(hit, lambda p: accepted(p) & ~right(p)) + _count(unreadable, lambda p: F.coalesce(accepted(p), F.lit(False))) + _count(invented, lambda t: t["status"] == "accepted"),
        "missed_tags": (F.size(readable) - F.size(hit)).cast("long"),
        "invented_tags": F.size(invented).cast("long"),
        "edits": _total(readable, lambda p: F.levenshtein(F.coalesce(p["prediction"]["text"], F.lit("")), p["label"]["text"]).cast("long")),
        "characters": _total(readable, lambda p: F.length(p["label"]["text"]).cast("long")),
    }


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole; unrounded."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


RATES = {
    "exact_match_rate": ("exact_matches", "readable_tags"),
    "character_error_rate": ("edits", "characters"),
    "automation_rate": ("accepted_correct", "readable_tags"),
    "silent_error_rate": ("silent_errors", "accepted_tags"),
    "fallback_share": ("fallback_tags", "predicted_tags"),
}


def summarise(outcomes: DataFrame, by_session: bool = True) -> DataFrame:
    """Counts and rates over all photos (session null, total true), and by session.

    Failed photos count in photos and failed_photos only. No photo at all gives a
    row of zeros.
    """
    read = F.col("error").isNull()
    per = {k: F.when(read, c).otherwise(F.lit(0)) for k, c in photo_counts(F.col("outcome")).items()}
    rows = outcomes.select("session", F.lit(1).alias("photos"), (~read).cast("int").alias("failed_photos"), F.when(read, F.col("seconds")).alias("seconds"), *(c.alias(k) for k, c in per.items()))
    sums = [F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(c) for c in COUNTS] + [F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")]
    if by_session:
        grouped = rows.groupingSets([[], [F.col("session")]], F.col("session")).agg(*sums, (F.grouping("session") == 1).alias("total"))
    else:
        grouped = rows.agg(*sums).withColumns({"session": F.lit(None).cast("string"), "total": F.lit(True)})
    rates = {k: rate(F.col(a), F.col(b)) for k, (a, b) in RATES.items()}
    rates["seconds_per_photo"] = rate(F.col("seconds"), F.col("photos") - F.col("failed_photos"))
    return grouped.withColumns(rates)


def cost_per_thousand(input_tokens: Column, output_tokens: Column, usd_in: Column, usd_out: Column, read: Column) -> Column:
    """US dollars per 1,000 photos read; null without a price or a photo."""
    return F.when(read > 0, (input_tokens * usd_in + output_tokens * usd_out) / 1e6 / read * 1000)


def costs(usage: DataFrame, prices: DataFrame, read: DataFrame) -> DataFrame:
    """Tokens and cost by model: usage(model, input_tokens, output_tokens), prices as PRICES, read(model, photos_read)."""
    total = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    rows = total.join(read, "model", "left").join(prices, "model", "left")
    return rows.select("model", "input_tokens", "output_tokens", cost_per_thousand(*(F.col(c) for c in ("input_tokens", "output_tokens", "usd_in", "usd_out", "photos_read"))).alias("usd_per_1000"))


def photos_per_minute(read_now: Column, seconds: Column) -> Column:
    """Throughput; null where nothing was read."""
    return F.when((read_now > 0) & (seconds > 0), read_now / seconds * 60)


def compare(base: DataFrame, new: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row per regression of new against base (one-row summaries): metric, base, new."""
    rates = {"exact_match_rate": -1, "silent_error_rate": 1}
    both = base.select(*(F.col(k).alias(f"b_{k}") for k in rates)).crossJoin(new.select(*(F.col(k).alias(f"n_{k}") for k in rates)))  # one row each
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"b_{k}").alias("base"), F.col(f"n_{k}").alias("new"), F.lit(sign).alias("sign")) for k, sign in rates.items()))
    return both.select(F.inline(rows)).where((F.col("new") - F.col("base")) * F.col("sign") > tolerance).select("metric", "base", "new")
