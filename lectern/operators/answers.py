"""Answers of vision providers: strict parsing in an Arrow UDF, instructions, and calls behind an interface."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.catalog import Catalog

# The answer format.
KEYS = {"text", "legibility", "alternatives", "box", "angle"}
LEGIBILITY = ("certain", "uncertain", "unreadable")
ANGLES = ("0", "90", "180", "270")
MAX_ALTERNATIVES = 3
FORMATS = {"pixels_xyxy": "x0, y0, x1, y1 in pixels", "normalized_xyxy": "x0, y0, x1, y1 in thousandths", "normalized_yxyx": "y0, x0, y1, x1 in thousandths"}
TAG = "struct<text:string,legibility:string,alternatives:array<string>,box:array<double>,angle:int>"
ANSWER = f"struct<tags:array<{TAG}>,error:string>"
_ARROW_TAG = pa.struct([("text", pa.string()), ("legibility", pa.string()), ("alternatives", pa.list_(pa.string())), ("box", pa.list_(pa.float64())), ("angle", pa.int32())])


def _box(raw: Any, kind: str, width: int, height: int) -> list[float]:
    if not isinstance(raw, list) or len(raw) != 4 or any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) for v in raw):
        raise ValueError("a box is four finite numbers")
    a, b, c, d = map(float, raw)
    if kind == "normalized_yxyx":
        a, b, c, d = b, a, d, c
    across, down = (width / 1000, height / 1000) if kind != "pixels_xyxy" else (1.0, 1.0)
    xs = sorted(min(max(v * across, 0.0), float(width)) for v in (a, c))
    ys = sorted(min(max(v * down, 0.0), float(height)) for v in (b, d))
    if xs[1] - xs[0] < 1 or ys[1] - ys[0] < 1:
        raise ValueError("a box leaves less than a pixel of the image")
    return [xs[0], ys[0], xs[1], ys[1]]


def _tag(raw: Any, kind: str, width: int, height: int) -> dict[str, Any]:
    if not isinstance(raw, dict) or raw.keys() != KEYS:
        raise ValueError("a tag has exactly text, legibility, alternatives, box and angle")
    others = raw["alternatives"]
    if not isinstance(raw["text"], str) or not isinstance(others, list) or not all(isinstance(a, str) for a in others):
        raise ValueError("text and alternatives are strings")
    if raw["legibility"] not in LEGIBILITY or raw["angle"] not in ANGLES:
        raise ValueError("legibility or angle is not one of the known ones")
    text = raw["text"].strip()
    distinct = [a for a in dict.fromkeys(a.strip() for a in others) if a and a != text]
    return {"text": text, "legibility": raw["legibility"] if text else "unreadable", "alternatives": distinct[:MAX_ALTERNATIVES], "box": _box(raw["box"], kind, width, height), "angle": int(raw["angle"])}


def parse_answer(text: str, kind: str, width: int, height: int) -> list[dict[str, Any]]:
    """The tags of an answer; ValueError if anything in it breaks the format."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("tags"), list):
        raise ValueError("tags is not an array")
    return [_tag(t, kind, width, height) for t in data["tags"]]


def parsed_answer(answer: Column, kind: str, width: Column, height: Column) -> Column:
    """struct<tags, error>: the tags, or invalid_response for the whole answer."""
    if kind not in FORMATS:
        raise ValueError(f"unknown box format {kind!r}")

    @F.arrow_udf(ANSWER)
    def run(texts: pa.Array, widths: pa.Array, heights: pa.Array) -> pa.Array:
        out = []
        for t, w, h in zip(texts.to_pylist(), widths.to_pylist(), heights.to_pylist(), strict=True):
            try:
                out.append({"tags": parse_answer(t, kind, w, h), "error": None})
            except (ValueError, TypeError):
                out.append({"tags": None, "error": "invalid_response"})
        return pa.array(out, pa.struct([("tags", pa.list_(_ARROW_TAG)), ("error", pa.string())]))

    return run(answer, width, height)


def instructions(catalog: Catalog, kind: str, width: int, height: int) -> str:
    """What a provider is asked; without kinds there is no section on formats."""
    if kind not in FORMATS:
        raise ValueError(f"unknown box format {kind!r}")
    parts = [
        "Read every identifier tag in this photo, and nothing else. Copy characters as they are; never guess a missing one.",
        f"Give each tag's box as {FORMATS[kind]}; the image is {width} by {height} pixels. angle is the clockwise turn of its text: 0, 90, 180 or 270.",
        f"legibility is certain, uncertain or unreadable. List up to {MAX_ALTERNATIVES} other possible readings, likeliest first.",
    ]
    if catalog.kinds:
        parts.insert(1, "Identifiers follow one of these patterns:\n" + "\n".join(f"- {k.tag_id}: {k.pattern}" for k in catalog.kinds))
    return "\n\n".join(parts)


class Provider(Protocol):
    """What a vision provider must offer; made anew in every task."""

    def read(self, request: dict[str, Any]) -> dict[str, Any]:
        """answer (JSON text), input_tokens and output_tokens for image bytes and instructions; or error and http_status."""
        ...


CALLS = "answer string, input_tokens long, output_tokens long, error string"


def ask(requests: DataFrame, provider: Callable[[], Provider]) -> DataFrame:
    """requests with the provider's answers; one failing request is an error in its row.

    Save the result before using it: a plan that is run again asks, and pays, again.
    """
    from pyspark.sql.types import StructType

    schema = StructType(requests.schema.fields + StructType.fromDDL(CALLS).fields)
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        client, arrow = provider(), to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    said = client.read(row)
                except Exception as e:  # noqa: BLE001 - any failure belongs to its row
                    said = {"error": f"{type(e).__name__}: {e}"[:300]}
                rows.append({c: row[c] for c in names} | {f: said.get(f) for f in ("answer", "input_tokens", "output_tokens", "error")})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return requests.mapInArrow(run, schema)


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls and tokens by keys, of answered calls; a key without an answer has no row."""
    answered = calls.where(F.col("error").isNull())
    return answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
