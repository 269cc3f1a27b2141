"""Command line: match, read, run, evaluate, compare and prelabel over files that Spark reads; models and serve beside it."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
import urllib.request
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.functions import decision
from lectern.plans import evaluation, reading, review
from lectern.sources import images, labels, models, results


def _match(spark: SparkSession, a: argparse.Namespace) -> int:
    catalog = Catalog.from_file(a.catalog)
    text = F.col(a.column)
    fitted = decision.without_stray_spaces(text, catalog)
    spark.read.parquet(a.input).withColumns({"fitted": fitted, "kind": catalog.kind_of(fitted)}).write.mode("overwrite").parquet(a.output)
    return 0


def _predictions(spark: SparkSession, path: str) -> object:
    rows = spark.read.text(path).select(results.parse_results(F.col("value")).alias("r")).select("r.*")
    return rows.select("image", "tags", "timings_ms", F.lit(None).cast("string").alias("error"))


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    read = labels.read_csv if a.labels.endswith(".csv") else labels.read_jsonl
    truth = labels.load(read(spark, a.labels), split=a.split)
    if truth.isEmpty():
        print("no labelled photo", file=sys.stderr)
        return 2
    rows = [r.asDict() for r in evaluation.evaluate(truth, _predictions(spark, a.predictions)).collect()]
    total = next(r for r in rows if r["total"])
    document = evaluation.report(total, [r for r in rows if not r["total"]], dataset=Path(a.labels).stem, split=a.split, backend=a.backend)
    Path(a.out).mkdir(parents=True, exist_ok=True)
    evaluation.save_report(document, a.out, evaluation.report_stem(Path(a.labels).stem, a.split or "all", a.backend))
    return 0


def _compare(_: SparkSession | None, a: argparse.Namespace) -> int:
    base, new = (json.loads(Path(p).read_text(encoding="utf-8"))["metrics"] for p in (a.base, a.new))
    worse = [k for k, sign in (("exact_match_rate", -1), ("silent_error_rate", 1)) if (new[k] - base[k]) * sign > a.tolerance]
    for k in worse:
        print(f"{k}: {base[k]:.1%} -> {new[k]:.1%}")
    return 1 if worse else 0


def _prelabel(spark: SparkSession, a: argparse.Namespace) -> int:
    first, *second = (_predictions(spark, p).withColumn("session", results.session_of(F.col("image"))) for p in a.predictions)
    merged = evaluation.merge_readers(first, *second)
    Path(a.out).mkdir(parents=True, exist_ok=True)
    results.write_labels_csv(merged, f"{a.out}/labels.csv")
    pictures = results.read_photos(spark, a.photos).select("image", images.thumbnail(F.col("content")).alias("picture")) if a.photos else None
    review.write_review(merged, a.out, a.title, pictures)
    return 0


def _factory(name: str) -> Callable[[], Any]:
    """module:function, which gives (classes, detector factory, recogniser factory, code decoder factory or None)."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _local(spark: SparkSession, a: argparse.Namespace, catalog: Catalog, folder: str) -> Callable[[DataFrame], DataFrame]:
    classes, detector, recognizer, decoder = _factory(a.models)()

    def save(rows: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return lambda photos: reading.read_local(photos, classes, catalog, detector, recognizer, decoder, a.open, a.backend, save)


def _missing(spark: SparkSession, a: argparse.Namespace, catalog: Catalog, photos: DataFrame, parts: int = 1) -> DataFrame:
    """Predictions of photos, read where they are missing; what the models said lies in a folder of this run until then."""
    folder = f"{a.table}/work-{uuid.uuid4().hex}"
    try:
        return results.read_missing(photos, a.table, a.backend, _local(spark, a, catalog, folder), a.force, lambda done, all_: print(f"{done} of {all_}", file=sys.stderr), parts)
    finally:
        results.delete(spark, folder)


def _said(row: dict[str, Any]) -> dict[str, Any]:
    return {"file": row["image"], "error": row["error"]} if row["error"] else {"file": row["image"], "result": json.loads(row["json"])}


def _read(spark: SparkSession, a: argparse.Namespace) -> int:
    catalog = Catalog.from_file(a.catalog)
    photos = results.read_photos(spark, *a.paths)
    found = _missing(spark, a, catalog, photos, a.parts)
    shown = results.in_order(found.select("image", "error", results.result_json(F.struct("image", "engine_version", "model_version", "tags", "timings_ms", "other_texts", "api_usage")).alias("json")))
    failed = 0
    if a.out:
        Path(a.out).mkdir(parents=True, exist_ok=True)
    for row in shown.toLocalIterator():
        line = _said(row.asDict())
        failed += "error" in line
        print(json.dumps(line, ensure_ascii=False))
        if a.out and "result" in line:
            Path(a.out, f"{row['image']}.json").write_text(json.dumps(line["result"], ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return 1 if failed else 0


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    catalog = Catalog.from_file(a.catalog)
    records = (labels.read_csv if a.labels.endswith(".csv") else labels.read_jsonl)(spark, a.labels)
    photos = results.read_photos(spark, *a.paths)
    truth = labels.load(records, photos, a.split)
    if a.limit:
        truth = truth.orderBy("image").limit(a.limit)
    if truth.isEmpty():
        print("no labelled photo", file=sys.stderr)
        return 2
    start = time.perf_counter()
    wanted = photos.join(truth.select("image"), "image", "left_semi")
    found = _missing(spark, a, catalog, wanted)
    rows = [r.asDict() for r in evaluation.evaluate(truth, found).collect()]
    total = next(r for r in rows if r["total"])
    tokens = found.agg(F.sum("api_usage.input_tokens").alias("input"), F.sum("api_usage.output_tokens").alias("output")).first().asDict()
    price = {"input": a.price[0], "output": a.price[1]} if a.price else None
    name = a.name or Path(a.labels).stem
    document = evaluation.report(total, [r for r in rows if not r["total"]], dataset=name, split=a.split, backend=a.backend, tokens={k: v or 0 for k, v in tokens.items()}, price_per_million_tokens=price, wall_seconds=round(time.perf_counter() - start, 2))
    Path(a.reports).mkdir(parents=True, exist_ok=True)
    evaluation.save_report(document, a.reports, evaluation.report_stem(name, a.split or "all", a.backend))
    return 0


def _models(a: argparse.Namespace) -> int:
    folder = models.cache_folder()
    if a.action == "path":
        print(folder)
        return 0
    known = models.manifests(a.manifests)
    if a.action == "list":
        for m in known:
            here = all((folder / m.name / f.name).is_file() for f in m.files)
            print(f"{m.name}\t{m.size / 1e6:.1f} MB\t{'downloaded' if here else 'not downloaded'}")
        return 0
    chosen = next((m for m in known if m.name == a.name), None)
    if chosen is None:
        print(f"no model {a.name!r}", file=sys.stderr)
        return 1
    try:
        for path in models.fetch(chosen, urllib.request.urlopen):
            print(path)
    except (models.ModelError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _serve(a: argparse.Namespace) -> int:
    from lectern import server

    try:
        config = server.ServerConfig.from_env()
    except server.ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    listed = [{"name": m.name, "bytes": m.size} for m in models.manifests(a.manifests)] if a.manifests else []
    server.make_server(config, _factory(a.reader)() if a.reader else None, listed, a.host, a.port).serve_forever()
    return 0


def _reading_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--catalog", required=True)
    parser.add_argument("--models", required=True, metavar="MODULE:FUNCTION", help="gives classes and factories of a detector, a recogniser and a code decoder")
    parser.add_argument("--table", required=True, help="the prediction table; what it holds is not read again")
    parser.add_argument("--backend", default="local")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--open", action="store_true", help="also give texts that are no tags")


def main(arguments: list[str] | None = None) -> int:
    """Run a command; 0: fine, 1: regression, 2: nothing to do or bad use."""
    parser = argparse.ArgumentParser(prog="lectern")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("match", help="classify texts of a Parquet table")
    for name in ("catalog", "input", "output"):
        one.add_argument(name)
    one.add_argument("--column", default="text")
    two = commands.add_parser("evaluate", help="judge predictions (JSON lines) against labels")
    for name in ("labels", "predictions", "out"):
        two.add_argument(name)
    two.add_argument("--split")
    two.add_argument("--backend", default="local")
    three = commands.add_parser("compare", help="find regressions between two reports")
    three.add_argument("base")
    three.add_argument("new")
    three.add_argument("--tolerance", type=float, default=0.0)
    four = commands.add_parser("prelabel", help="merge one or two readers into a review page")
    four.add_argument("out")
    four.add_argument("predictions", nargs="+")
    four.add_argument("--title", default="review")
    four.add_argument("--photos", help="folder of photos to show beside their rows")
    five = commands.add_parser("read", help="read photos and print one JSON line a photo")
    five.add_argument("paths", nargs="+", help="photos or folders of photos")
    _reading_options(five)
    five.add_argument("--out", help="also write a JSON file a photo here")
    five.add_argument("--parts", type=int, default=1, help="runs that are saved one after the other")
    six = commands.add_parser("run", help="read labelled photos and write a report")
    six.add_argument("labels")
    six.add_argument("paths", nargs="+")
    _reading_options(six)
    six.add_argument("--split")
    six.add_argument("--limit", type=int, help="only the first photos by name")
    six.add_argument("--reports", default="reports")
    six.add_argument("--name")
    six.add_argument("--price", nargs=2, type=float, metavar=("IN", "OUT"), help="USD for a million tokens")
    seven = commands.add_parser("models", help="list and fetch models")
    seven.add_argument("action", choices=("list", "download", "path"))
    seven.add_argument("name", nargs="?")
    seven.add_argument("--manifests", default=".")
    eight = commands.add_parser("serve", help="answer over HTTP; settings come from the environment")
    eight.add_argument("--host", default="127.0.0.1")
    eight.add_argument("--port", type=int, default=8000)
    eight.add_argument("--reader", metavar="MODULE:FUNCTION", help="gives the function that reads one photo")
    eight.add_argument("--manifests")
    a = parser.parse_args(arguments)
    if a.command in ("models", "serve"):
        return {"models": _models, "serve": _serve}[a.command](a)
    if a.command == "compare":
        return _compare(None, a)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    return {"match": _match, "read": _read, "run": _run, "evaluate": _evaluate, "prelabel": _prelabel}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
