"""From pixels to lines: detection, recognition and bar codes as Arrow maps around injected implementations.

A factory makes the implementation once in every task, so models load where they
run. A photo that cannot be read is an error in its row and takes no other along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.operators.vision import CodeDecoder, Detector, Recognizer, boxes
from lectern.sources import images

POINTS = "array<struct<x:double,y:double>>"
CROPS = f"photo string, line_no int, quad {POINTS}, score double, turn int, turn_ord int, probs array<array<double>>, error string"
CODES = f"photo string, ord int, text string, symbology string, quad {POINTS}, angle double, error string"
#: Longest side that lines are looked for on, and how much taller than wide a line is before quarter turns are tried.
MAX_SIDE = 1536
TALL = 1.2


def crop(pixels: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The upright rectangle that a quad (clockwise from the top left) spans, sampled linearly."""
    q = np.asarray(quad, float)
    width, height = (max(2, round(float(np.hypot(*(q[i] - q[0]))))) for i in (1, 3))
    u, v = np.meshgrid((np.arange(width) + 0.5) / width, (np.arange(height) + 0.5) / height)
    place = (1 - u)[..., None] * ((1 - v)[..., None] * q[0] + v[..., None] * q[3]) + u[..., None] * ((1 - v)[..., None] * q[1] + v[..., None] * q[2]) - 0.5
    high = np.array(pixels.shape[1::-1]) - 1
    low = np.clip(np.floor(place), 0, high).astype(int)
    far, part = np.minimum(low + 1, high), np.clip(place - low, 0, 1)
    at = lambda x, y: pixels[y, x].astype(float)
    top = at(low[..., 0], low[..., 1]) * (1 - part[..., :1]) + at(far[..., 0], low[..., 1]) * part[..., :1]
    bottom = at(low[..., 0], far[..., 1]) * (1 - part[..., :1]) + at(far[..., 0], far[..., 1]) * part[..., :1]
    return np.rint(top * (1 - part[..., 1:]) + bottom * part[..., 1:]).astype(np.uint8)


def turns_of(pixels: np.ndarray) -> tuple[int, ...]:
    """Turns worth trying on a crop: a tall one may hold text turned by a quarter."""
    return (0, 180, 90, 270) if pixels.shape[0] > TALL * pixels.shape[1] else (0, 180)


def _quad(points: list[Any], scale: float) -> list[dict[str, float]]:
    return [{"x": round(float(x) * scale, 1), "y": round(float(y) * scale, 1)} for x, y in points]


def _photos(batch: pa.RecordBatch, make: Callable[[], images.Codec], max_side: int) -> Iterator[tuple[str, np.ndarray | None, float, str | None]]:
    """(photo, pixels, scale, error) of each row (image, content)."""
    codec = make()
    for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        try:
            pixels, width, *_ = images.prepare(content.as_py() or b"", max_side, codec)
            yield name, pixels, width / pixels.shape[1], None
        except images.ImageError as e:
            yield name, None, 1.0, str(e)


def recognised(photos: DataFrame, detector: Callable[[], Detector], recognizer: Callable[[], Recognizer], max_side: int = MAX_SIDE, make: Callable[[], images.Codec] = images.codec) -> DataFrame:
    """CROPS of photos (image, content): a row for each line and turn, what plans.reading.read_lines takes; one row with an error for a photo that fails."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CROPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, read = detector(), recognizer()
        for batch in batches:
            for name, pixels, scale, error in _photos(batch, make, max_side):
                rows = [{"photo": name, "line_no": None, "error": error}] if error else []
                for i, line in enumerate([] if pixels is None else find.detect(pixels)):
                    cut = crop(pixels, line["quad"])
                    common = {"photo": name, "line_no": i, "quad": _quad(line["quad"], scale), "score": float(line["score"]), "error": None}
                    for k, turn in enumerate(turns_of(cut)):
                        rows.append(common | {"turn": turn, "turn_ord": k, "probs": np.asarray(read.probabilities(np.rot90(cut, turn // 90)), float).tolist()})
                if rows:  # photos go on one by one: their matrices are large
                    yield pa.RecordBatch.from_pylist([{f.name: None for f in schema} | r for r in rows], schema=schema)

    return photos.select("image", "content").mapInArrow(run, CROPS)


def decoded(photos: DataFrame, decoder: Callable[[], CodeDecoder], max_side: int = 1 << 30, make: Callable[[], images.Codec] = images.codec) -> DataFrame:
    """CODES of photos (image, content): bar codes and 2D codes in the order they are found; blank ones go."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = decoder()
        for batch in batches:
            rows = []
            for name, pixels, scale, error in _photos(batch, make, max_side):
                rows += [{"photo": name, "error": error}] if error else []
                found = [] if pixels is None else [c for c in find.decode(pixels) if c["text"].strip()]
                rows += [{"photo": name, "ord": i, "text": c["text"].strip(), "symbology": c["symbology"], "quad": _quad(c["quad"], scale), "angle": float(c["angle"]) % 360} for i, c in enumerate(found)]
            yield pa.RecordBatch.from_pylist([{f.name: None for f in schema} | r for r in rows], schema=schema)

    return photos.select("image", "content").mapInArrow(run, CODES)


def _normal(pixels: np.ndarray, settings: dict[str, Any]) -> np.ndarray:
    """Channels first, between 0 and 1, then standardised; the model's channel order."""
    x = pixels.astype(np.float32) / 255
    x = x[..., ::-1] if settings.get("channel_order") == "BGR" else x
    return ((x - np.array(settings["mean"], np.float32)) / np.array(settings["std"], np.float32)).transpose(2, 0, 1)


class OnnxDetector:
    """Lines from the text-probability map of a model; session: anything with run() and get_inputs()."""

    def __init__(self, session: Any, settings: dict[str, Any]) -> None:
        self.session, self.settings, self.input = session, settings, session.get_inputs()[0].name

    def detect(self, pixels: np.ndarray) -> list[dict[str, Any]]:
        """quad and score of each line, in pixels of the image."""
        s, (height, width) = self.settings, pixels.shape[:2]
        step, scale = int(s["multiple_of"]), min(1.0, s["limit_side"] / max(height, width))
        w, h = (max(step, round(side * scale / step) * step) for side in (width, height))
        batch = _normal(images.resized(pixels, w, h), s)[None]
        found = boxes(np.asarray(self.session.run(None, {self.input: batch})[0][0, 0], float), s["threshold"], s["box_threshold"], s["unclip_ratio"])
        return [{"quad": [(float(x) * width / w, float(y) * height / h) for x, y in quad], "score": score} for quad, score in found]


class OnnxRecognizer:
    """Class probabilities of a line; class 0 is blank."""

    def __init__(self, session: Any, settings: dict[str, Any], classes: list[str]) -> None:
        self.session, self.settings, self.classes, self.input = session, settings, classes, session.get_inputs()[0].name

    def probabilities(self, pixels: np.ndarray) -> np.ndarray:
        """A row of class probabilities for each step."""
        s, (height, width) = self.settings, pixels.shape[:2]
        tall = int(s["height"])
        w = min(max(math.ceil(width * tall / height), 1), int(s["max_width"]))
        batch = np.zeros((1, 3, tall, max(w, int(s["min_width"]))), np.float32)
        batch[0, :, :, :w] = _normal(images.resized(pixels, w, tall), s)
        out = np.asarray(self.session.run(None, {self.input: batch})[0][0], float)
        if out.shape[1] != len(self.classes):
            raise ValueError(f"the model has {out.shape[1]} classes, the manifest {len(self.classes)}")
        return out


class ZxingDecoder:
    """Codes that zxing-cpp finds, where it is installed."""

    def decode(self, pixels: np.ndarray) -> list[dict[str, Any]]:
        """text, symbology, quad and angle of each valid code."""
        import zxingcpp

        corners = ("top_left", "top_right", "bottom_right", "bottom_left")
        found = [c for c in zxingcpp.read_barcodes(pixels) if c.valid]
        return [{"text": c.text, "symbology": str(c.format), "quad": [(getattr(c.position, k).x, getattr(c.position, k).y) for k in corners], "angle": c.orientation} for c in found]
