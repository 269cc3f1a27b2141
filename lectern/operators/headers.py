"""Headers printed beside identifiers: fuzzy search in a photo's text, and the kinds they choose."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.functions.decision import normalised_header

SIMILARITY = 0.8


def plain(text: str) -> str:
    """Upper-case letters and digits."""
    return "".join(filter(str.isalnum, text.upper()))


def holds(text: str, header: str, similarity: float = SIMILARITY) -> bool:
    """Whether a stretch of text as long as header is similar enough; both are plain."""
    n = len(header)
    if not n or header in text:
        return bool(n)
    if len(text) < n * similarity:
        return False
    matcher = SequenceMatcher(autojunk=False)
    for at in range(max(1, len(text) - n + 1)):
        matcher.set_seqs(header, text[at : at + n])
        if matcher.real_quick_ratio() >= similarity and matcher.quick_ratio() >= similarity and matcher.ratio() >= similarity:
            return True
    return False


def headers_in(text: Column, catalog: Catalog, similarity: float = SIMILARITY) -> Column:
    """array<string>: ids of the kinds whose header the text holds; a literal without headers in the catalog."""
    wanted = [(k.tag_id, plain(k.header)) for k in catalog.kinds if k.header is not None]
    if not wanted:
        return F.array().cast("array<string>")

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([[k for k, h in wanted if holds(plain(t.as_py() or ""), h, similarity)] for t in column], pa.list_(pa.string()))

    exact = F.array_compact(F.array(*(F.when(F.contains(normalised_header(text), F.lit(h)), F.lit(k)) for k, h in wanted)))
    # all found exactly: no Python needed for the answer
    return F.when(F.size(exact) == len(wanted), exact).otherwise(run(text))


def photo_headers(lines: DataFrame, catalog: Catalog, similarity: float = SIMILARITY) -> DataFrame:
    """(photo, seen) from lines (photo, line_no, plain_text): a header may run over several lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "plain_text"))), lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")
    return lines.groupBy("photo").agg(text.alias("_text")).select("photo", headers_in(F.col("_text"), catalog, similarity).alias("seen"))


def with_kinds(lines: DataFrame, catalog: Catalog, similarity: float = SIMILARITY) -> DataFrame:
    """lines whose readings array<struct<text, probability, tag_id>> name the kind their photo's headers choose."""
    if all(k.header is None for k in catalog.kinds):
        return lines
    chosen = F.transform("readings", lambda r: F.struct(r["text"].alias("text"), r["probability"].alias("probability"), catalog.best_kind(r["text"], r["tag_id"], F.col("seen")).alias("tag_id")))
    return lines.join(photo_headers(lines, catalog, similarity), "photo", "left").withColumn("readings", chosen).drop("seen")
