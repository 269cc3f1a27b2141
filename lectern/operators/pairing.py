"""Pairing predictions with labels of the same photo, one to one, as array expressions.

Near texts pair first: candidates with a character error rate of a half at most, in
order of (rate, label, prediction). Then, in index order, what is left: labels no
person could read with predictions that have a text, readable labels with
predictions without one, and unreadable labels with those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

MAX_RATE = 0.5
_PAIRS = "array<struct<li:int,pi:int>>"


def _indexes(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def _pair(li: Column, pi: Column) -> Column:
    return F.struct(li.cast("int").alias("li"), pi.cast("int").alias("pi"))


def candidates(labels: Column, predictions: Column) -> Column:
    """array<struct<cer, li, pi>> of near texts, sorted; null texts are near nothing."""

    def near(label: Column, li: Column) -> Column:
        size = F.greatest(F.length(label), F.lit(1))

        def one(p: Column, pi: Column) -> Column:
            # the length difference bounds the distance from below, so most pairs cost nothing
            close = F.abs(F.length(p) - F.length(label)) <= MAX_RATE * size
            return F.when(close, F.struct((F.levenshtein(p, label) / size).alias("cer"), li.alias("li"), pi.alias("pi")))

        return F.filter(F.transform(predictions, one), lambda x: x.isNotNull() & (x["cer"] <= MAX_RATE))

    return F.array_sort(F.flatten(F.transform(labels, near)))


def pairs(labels: Column, predictions: Column) -> Column:
    """array<struct<li, pi>> for arrays of label and prediction texts; null: unreadable, or without a text."""

    def free(texts: Column, blank: bool, done: Column, side: str) -> Column:
        used = F.transform(done, lambda d: d[side])
        return F.filter(_indexes(texts), lambda i: (F.get(texts, i).isNull() == blank) & ~F.array_contains(used, i))

    def then(done: Column, steps: tuple[tuple[bool, bool], ...]) -> Column:
        if not steps:
            return done
        (no_label, no_text), *rest = steps

        def zipped(ls: Column, ps: Column) -> Column:
            k = F.least(F.size(ls), F.size(ps))
            return F.concat(done, F.zip_with(F.slice(ls, F.lit(1), k), F.slice(ps, F.lit(1), k), _pair))

        more = let(free(labels, no_label, done, "li"), lambda ls: let(free(predictions, no_text, done, "pi"), lambda ps: zipped(ls, ps)))
        return let(more, lambda d: then(d, tuple(rest)))

    greedy = F.aggregate(
        candidates(labels, predictions),
        F.array().cast(_PAIRS),
        lambda done, x: F.when(F.exists(done, lambda d: (d["li"] == x["li"]) | (d["pi"] == x["pi"])), done).otherwise(F.concat(done, F.array(_pair(x["li"], x["pi"])))),
    )
    return let(greedy, lambda d: then(d, ((True, False), (False, True), (True, True))))


def paired(labels: Column, predictions: Column, label_text: str = "text", text: str = "text") -> Column:
    """struct<pairs: array<struct<label, prediction>>, invented: array<prediction>> from arrays of structs.

    Every label has a pair, with a null prediction where it has none.
    """

    def outcome(links: Column) -> Column:
        partner = F.map_from_entries(links)
        both = let(partner, lambda m: F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.get(predictions, F.try_element_at(m, i)).alias("prediction"))))
        used = F.transform(links, lambda d: d["pi"])
        return F.struct(both.alias("pairs"), F.filter(predictions, lambda x, i: ~F.array_contains(used, i)).alias("invented"))

    def linked(ls: Column) -> Column:
        return let(F.transform(predictions, lambda x: x[text]), lambda ps: let(pairs(ls, ps), outcome))

    return let(F.transform(labels, lambda x: x[label_text]), linked)
