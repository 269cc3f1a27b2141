"""Labels from JSON lines or CSV, with the rules that decide which photos count.

Records are (line_no, image, session, split, tag_id, text, polygon, verified,
has_verified). Malformed input raises DatasetError at load, naming the first bad
line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNREADABLE, NO_TAG, PLACEHOLDER, EXAMPLE = "?", "-", "A_REMPLIR", "EXEMPLE_"
YES = ("yes", "oui", "y", "x", "1", "true")
FIELDS = "image string, session string, split string, tag_id string, text string, polygon array<array<double>>, verified string"
COLUMNS = ("line_no", "image", "session", "split", "tag_id", "text", "polygon", "verified", "has_verified")


class DatasetError(ValueError):
    """Labels are malformed or contradict each other."""


def is_yes(value: Column) -> Column:
    """Whether a verified mark says yes; null does not."""
    return F.coalesce(F.lower(F.btrim(value)).isin(*YES), F.lit(False))


def has_tag(text: Column) -> Column:
    """Whether a label's text names a tag, readable or not."""
    return text.isNotNull() & ~text.isin("", NO_TAG)


def label_text(text: Column) -> Column:
    """The text of a tag; null where no person can read it."""
    return F.when(has_tag(text) & (text != UNREADABLE), text)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file that may be split: line_no rises with the line's place, as no line is shorter than a byte."""
    rows = spark.read.text(path)
    number = F.input_file_block_start() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.select(number.alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def _where(lines: DataFrame, place: int) -> int:
    """The number, from 1, of the line at a place."""
    return lines.where(F.col("line_no") <= place).count()


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines and placeholder texts do not count."""
    every = _lines(spark, path)
    lines = every.where(F.btrim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    keys = F.json_object_keys("value")
    bad = parsed.where(keys.isNull()).agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise DatasetError(f"line {_where(every, bad)}: not a JSON object")
    rows = parsed.select("line_no", "r.*", F.array_contains(keys, "verified").alias("has_verified"))
    return _checked(rows.where(F.coalesce(F.col("text") != PLACEHOLDER, F.lit(True))).select(*COLUMNS), lambda place: _where(every, place))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; ; separates if the header has more of them than commas. Quoted fields may hold separators and line breaks.

    Rows without an image, examples and placeholders do not count. line_no counts
    records, the header being the first.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head or not head[0][0].strip("\ufeff"):
        return spark.createDataFrame([], f"line_no long, {FIELDS}, has_verified boolean").select(*COLUMNS)
    sep = ";" if head[0][0].count(";") > head[0][0].count(",") else ","
    table = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=True)
    names = [c.lstrip("\ufeff").strip().strip('"') for c in table.columns]
    table = table.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("line_no", F.monotonically_increasing_id() + 2)
    columns = {n: F.btrim(F.coalesce(F.col(f"c{i}"), F.lit(""))) for i, n in enumerate(names) if n}
    text = lambda n: columns.get(n, F.lit(None).cast("string"))
    rows = table.select(
        "line_no", text("image").alias("image"), text("session").alias("session"), text("split").alias("split"), text("tag_id").alias("tag_id"), text("text").alias("text"),
        F.lit(None).cast("array<array<double>>").alias("polygon"), text("verified").alias("verified"), F.lit("verified" in names).alias("has_verified"),
    )
    rows = rows.where((F.col("image") != "") & ~F.startswith("image", F.lit(EXAMPLE)) & F.coalesce(F.col("text") != PLACEHOLDER, F.lit(True)))
    return _checked(rows, int)


def _checked(rows: DataFrame, number: Callable[[int], int]) -> DataFrame:
    bad = rows.where(F.col("image").isNull() | (F.col("image") == "")).agg(F.min("line_no")).first()[0]
    if bad is not None:
        raise DatasetError(f"line {number(bad)}: image is missing")
    return rows


def split_conflicts(records: DataFrame) -> DataFrame:
    """Sessions that stand in more than one split."""
    split = F.coalesce(F.nullif("split", F.lit("")), F.lit(""))
    return records.groupBy(F.coalesce("session", F.lit("")).alias("session")).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def load(records: DataFrame, photos: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """One row per photo that counts: image, session, split, tags array<struct<li, text, tag_id, polygon>>.

    A photo with any row marked as not verified is left out; a photo without a tag has
    an empty array. photos (image): a record of a photo not in it is an error, like a
    session in two splits. A photo's session and split are those of its first record.
    """
    if photos is not None:
        missing = records.join(photos.select("image"), "image", "left_anti").agg(F.min(F.struct("line_no", "image")).alias("m")).first()["m"]
        if missing is not None:
            raise DatasetError(f"line {missing['line_no']}: photo {missing['image']!r} not found")
    conflict = split_conflicts(records).agg(F.min("session")).first()[0]
    if conflict is not None:
        raise DatasetError(f"session {conflict!r} is in several splits; split by session, never by photo")
    tag = F.struct("line_no", label_text(F.col("text")).alias("text"), F.nullif("tag_id", F.lit("")).alias("tag_id"), "polygon")
    first = lambda c: F.min_by(F.coalesce(F.col(c), F.lit("")), "line_no")
    waiting = F.bool_or(F.col("has_verified") & ~is_yes(F.col("verified")))
    photo = records.groupBy("image").agg(
        first("session").alias("session"), F.nullif(first("split"), F.lit("")).alias("split"), waiting.alias("waiting"),
        F.array_sort(F.collect_list(F.when(has_tag(F.col("text")), tag))).alias("tags"),
    )
    tags = F.transform("tags", lambda t, i: F.struct(i.alias("li"), t["text"].alias("text"), t["tag_id"].alias("tag_id"), t["polygon"].alias("polygon")))
    kept = photo.where(~F.col("waiting"))
    if split is not None:
        kept = kept.where(F.col("split") == split)
    return kept.select("image", "session", "split", tags.alias("tags"))
