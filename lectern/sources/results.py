"""Photos, the prediction table that spares a second reading, and results as JSON."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff")
POINTS = "array<struct<x:double,y:double>>"
CANDIDATES = "array<struct<text:string,confidence:double>>"
TAG = f"struct<tag_id:string,text:string,confidence:double,status:string,polygon:{POINTS},angle:double,candidates:{CANDIDATES},source:string>"
OTHER = f"struct<text:string,confidence:double,tag_likelihood:double,kind_guess:string,polygon:{POINTS},angle:double>"
USAGE = "struct<calls:long,input_tokens:long,output_tokens:long>"
RESULT = f"image string, engine_version string, model_version string, tags array<{TAG}>, timings_ms map<string,double>, other_texts array<{OTHER}>, api_usage {USAGE}"


def _listed(files: DataFrame) -> DataFrame:
    return files.withColumn("image", F.element_at(F.split("path", "/"), -1))


def is_photo(name: Column) -> Column:
    """Whether a file name ends like a photo's, in any case."""
    return F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES)


def read_photos(spark: SparkSession, *paths: str) -> DataFrame:
    """(image, path, content) of photos: of a folder those with a photo's suffix, and files that are named as they are.

    Rows have no order, as their contents should not travel for one; in_order() gives
    it to what is made of them.
    """
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = _listed(spark.read.format("binaryFile").load(path))
        whole = any(c in path for c in "*?[{") or fs(target).getFileStatus(target).isDirectory()
        parts.append((rows.where(is_photo(F.col("image"))) if whole else rows).withColumn("_part", F.lit(len(parts))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("image", "path", "content")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by file name, for a sink."""
    return rows.orderBy("image")


def session_of(name: Column, taken: Column | None = None) -> Column:
    """YYYY-MM-DD from a phone's file name, else from the EXIF stamp, else empty."""
    parts = r"\A(?:IMG_|PXL_)?([0-9]{4})([0-9]{2})([0-9]{2})"
    from_name = F.when(name.rlike(parts), F.concat_ws("-", *(F.regexp_extract(name, parts, i) for i in (1, 2, 3))))
    stamp = F.lit(None).cast("string") if taken is None else F.when(taken.rlike(r"\A[0-9]{4}:[0-9]{2}:[0-9]{2}"), F.replace(F.substring(taken, 1, 10), F.lit(":"), F.lit("-")))
    return F.coalesce(from_name, stamp, F.lit(""))


def unread(photos: DataFrame, predictions: DataFrame, backend: str) -> DataFrame:
    """Photos without a result of backend: a photo that failed is read again; the key is the whole file name."""
    done = predictions.where((F.col("backend") == backend) & F.col("error").isNull()).select("image")
    return photos.join(done, "image", "left_anti")


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever Spark keeps it."""
    target, files = _path(spark, path)
    files.delete(target, True)


def predictions(spark: SparkSession, table: str, backend: str) -> DataFrame | None:
    """The backend's predictions, one row a photo: the newest result, or the newest failure where there is none; None without any.

    Every run and every batch of a stream is a folder run=... of its own under
    backend=..., so runs only add; none rewrites what another has read.
    """
    target, files = _path(spark, f"{table}/backend={backend}")
    if not files.exists(target) or not any(x.getPath().getName().startswith("run=") for x in files.listStatus(target)):
        return None
    rows = spark.read.parquet(f"{table}/backend={backend}").drop("run")
    own = [c for c in rows.columns if c not in ("image", "read_at")]
    best = F.max_by(F.struct(*own), F.struct(F.col("error").isNull().alias("ok"), "read_at")).alias("p")
    return rows.groupBy("image").agg(best).select("image", "p.*").withColumn("backend", F.lit(backend))


def save_run(rows: DataFrame, table: str, backend: str, run: str) -> None:
    """Write what a reader made as one run; the same run written again replaces itself."""
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    rows.withColumn("read_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{table}/backend={backend}/run={run}")


def read_missing(photos: DataFrame, table: str, backend: str, reader: Callable[[DataFrame], DataFrame], force: bool = False, progress: Callable[[int, int], None] | None = None, parts: int = 1) -> DataFrame:
    """Read the photos whose result the prediction table lacks (force: all of photos), add it, and return the predictions of photos.

    What was read is on disk before it is used, so nothing is read or paid twice. With
    parts, photos are read in as many runs, each saved before the next, and progress
    hears how many are done; a run that breaks off loses one part.
    """
    spark = photos.sparkSession
    known = predictions(spark, table, backend)
    todo = photos if force or known is None else unread(photos, known, backend)
    run = uuid.uuid4().hex
    for i in range(parts):
        share = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("image"), F.lit(parts)) == i)
        save_run(reader(share), table, backend, f"{run}-{i}")
        if progress is not None:
            progress(i + 1, parts)
    return predictions(spark, table, backend).join(photos.select("image"), "image", "left_semi")


def result_json(row: Column) -> Column:
    """A result struct as compact JSON; optional keys that are null are left out."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def parse_results(text: Column) -> Column:
    """The struct of a result document."""
    return F.from_json(text, RESULT)


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _unit(v: Column) -> Column:
    return _finite(v) & v.between(0, 1)


def _some(v: Column) -> Column:
    return v.isNotNull() & (v != "")


def _placed(record: Column) -> dict[str, Column]:
    return {
        "four_finite_points": (F.size(record["polygon"]) == 4) & F.forall(record["polygon"], lambda p: _finite(p["x"]) & _finite(p["y"])),
        "angle_in_circle": _finite(record["angle"]) & (record["angle"] >= 0) & (record["angle"] < 360),
    }


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def violations(tag: Column) -> Column:
    """array<string>: the rules a tag breaks."""
    confidences = F.transform(tag["candidates"], lambda c: c["confidence"])
    falling = F.forall(F.transform(F.slice(confidences, 2, 1 << 30), lambda c, i: c <= F.get(confidences, i)), lambda ok: ok)
    return _broken({
        "text_iff_readable": tag["text"].isNull() == (tag["status"] == "unreadable"),
        "accepted_has_kind": (tag["status"] != "accepted") | tag["tag_id"].isNotNull(),
        **_placed(tag),
        "confidence_in_range": _unit(tag["confidence"]),
        "candidates_fall": falling,
        "known_status": tag["status"].isin("accepted", "review", "unreadable"),
        "known_source": tag["source"].isin("local", "fallback", "barcode"),
        "candidates_hold": F.forall(tag["candidates"], lambda c: F.size(candidate_violations(c)) == 0),
    })


def candidate_violations(candidate: Column) -> Column:
    """The rules a candidate breaks."""
    return _broken({"text_given": _some(candidate["text"]), "confidence_in_range": _unit(candidate["confidence"])})


def other_text_violations(other: Column) -> Column:
    """The rules a text that is no tag breaks."""
    return _broken({
        "text_given": _some(other["text"]), "confidence_in_range": _unit(other["confidence"]), "likelihood_in_range": _unit(other["tag_likelihood"]),
        "known_kind": other["kind_guess"].isin("id", "header", "noise"), **_placed(other),
    })


def usage_violations(usage: Column) -> Column:
    """The rules token counts break."""
    return _broken({f"{c}_counted": usage[c].isNotNull() & (usage[c] >= 0) for c in ("calls", "input_tokens", "output_tokens")})


def image_violations(image: Column) -> Column:
    """The rules an image's size and turn (width, height, exif_rotation) break."""
    return _broken({"width_positive": image["width"] >= 1, "height_positive": image["height"] >= 1, "quarter_turn": image["exif_rotation"].isin(0, 90, 180, 270)})


def result_violations(result: Column) -> Column:
    """The rules a result and the records in it break."""
    sound = lambda items, rules: F.forall(items, lambda x: F.size(rules(x)) == 0)
    return _broken({
        "engine_named": _some(result["engine_version"]), "model_named": _some(result["model_version"]),
        "tags_hold": sound(result["tags"], violations),
        "other_texts_hold": result["other_texts"].isNull() | sound(result["other_texts"], other_text_violations),
        "usage_holds": result["api_usage"].isNull() | (F.size(usage_violations(result["api_usage"])) == 0),
        "timings_hold": result["timings_ms"].isNull() | F.forall(F.map_entries(result["timings_ms"]), lambda e: _some(e["key"]) & _finite(e["value"]) & (e["value"] >= 0)),
    })


FIXED = ("image", "session", "tag_id", "text", "verified", "notes", "ai_1", "ai_2")


def write_labels_csv(rows: DataFrame, path: str) -> None:
    """The review table as one CSV file with the fixed columns, by photo and row; spreadsheets know its UTF-8 by the mark it starts with.

    Rows come to the driver a partition at a time.
    """
    shown = [F.lit("").alias(c) if c not in rows.columns else F.col(c) for c in FIXED]
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        table = csv.writer(out)
        table.writerow(FIXED)
        table.writerows(rows.orderBy("image", "row_no").select(*shown).toLocalIterator())
