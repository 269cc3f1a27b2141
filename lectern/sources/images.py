"""Images as columns: decoding, upright turns, shrinking and JPEG, behind a codec that executors make.

Pillow is used where it is installed; without it the plain pixel maps (P6) still
work, and every other image is an error in its row.
"""

from __future__ import annotations

import importlib.util
import io
import warnings
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.geometry import EXIF_TURNS

PREPARED = "struct<content:binary,width:int,height:int,scale:double,exif_rotation:int,error:string>"
#: JPEG quality, and the side of a review page's pictures.
QUALITY = 90
THUMBNAIL = 320


class ImageError(ValueError):
    """An image that cannot be read."""


class Codec(Protocol):
    """Turns encoded images into pixels and back."""

    def decode(self, content: bytes) -> tuple[np.ndarray, int]:
        """Pixels (height, width, 3) as stored and the EXIF orientation (1 where there is none); ImageError."""
        ...

    def encode(self, pixels: np.ndarray) -> bytes:
        """An image file without any metadata."""
        ...


class PixelMap:
    """Binary pixel maps (P6), which need no library."""

    def decode(self, content: bytes) -> tuple[np.ndarray, int]:
        """See Codec."""
        head = content.split(maxsplit=4)
        if len(head) < 5 or head[0] != b"P6" or head[3] != b"255":
            raise ImageError("not a pixel map")
        width, height = int(head[1]), int(head[2])
        pixels = np.frombuffer(content, np.uint8)[-width * height * 3 :]
        if not width * height or len(pixels) != width * height * 3:
            raise ImageError("the pixel map is cut off")
        return pixels.reshape(height, width, 3), 1

    def encode(self, pixels: np.ndarray) -> bytes:
        """See Codec."""
        return b"P6 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


class Pillow:
    """All formats of Pillow in, JPEG out; suspiciously large images are errors."""

    def decode(self, content: bytes) -> tuple[np.ndarray, int]:
        """See Codec."""
        from PIL import Image

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("error", Image.DecompressionBombWarning)
                picture = Image.open(io.BytesIO(content))
                return np.asarray(picture.convert("RGB")), int(picture.getexif().get(0x0112, 1) or 1)
        except Exception as e:  # noqa: BLE001 - whatever a broken file makes the library say
            raise ImageError(f"{type(e).__name__}: {e}"[:200]) from None

    def encode(self, pixels: np.ndarray) -> bytes:
        """See Codec."""
        from PIL import Image

        out = io.BytesIO()
        Image.fromarray(pixels).save(out, format="JPEG", quality=QUALITY, optimize=True)
        return out.getvalue()


def codec() -> Codec:
    """Pillow where it is installed, else pixel maps only."""
    return Pillow() if importlib.util.find_spec("PIL") else PixelMap()


def upright(pixels: np.ndarray, orientation: int) -> tuple[np.ndarray, int]:
    """Pixels turned and mirrored as an EXIF orientation asks, and the clockwise turn."""
    turn = EXIF_TURNS[orientation - 1] if 1 <= orientation <= 8 else 0
    turned = np.rot90(pixels, -turn // 90)
    if orientation in (2, 4, 5, 7):  # mirrored across the upright image
        turned = turned[:, ::-1]
    return turned, turn


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels at another size: means over the areas that they shrink to, linear in between where they grow."""

    def weights(old: int, new: int) -> np.ndarray:
        reach = max(1.0, old / new)
        centre = (np.arange(new) + 0.5) * old / new
        w = np.maximum(0.0, 1 - np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / reach)
        return w / w.sum(axis=1, keepdims=True)

    flat = np.tensordot(weights(pixels.shape[0], height), pixels.astype(float), 1)
    both = np.tensordot(weights(pixels.shape[1], width), flat, axes=(1, 1)).swapaxes(0, 1)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def prepare(content: bytes, max_side: int, made: Codec) -> tuple[np.ndarray, int, int, int]:
    """(upright pixels with sides of at most max_side, width and height before, clockwise turn)."""
    pixels, turn = upright(*made.decode(content))
    height, width = pixels.shape[:2]
    if (side := max(width, height)) > max_side:
        pixels = resized(pixels, max(1, round(width * max_side / side)), max(1, round(height * max_side / side)))
    return pixels, width, height, turn


def prepared(content: Column, max_side: int, make: Callable[[], Codec] = codec) -> Column:
    """PREPARED of encoded images: upright, at most max_side, encoded anew without metadata; a fault is an error in its row."""
    if max_side < 1:
        raise ValueError("max_side is at least 1")

    @F.arrow_udf(PREPARED)
    def run(contents: pa.Array) -> pa.Array:
        made, out = make(), []
        for x in contents:
            try:
                pixels, width, height, turn = prepare(x.as_py() or b"", max_side, made)
                out.append({"content": made.encode(pixels), "width": width, "height": height, "scale": width / pixels.shape[1], "exif_rotation": turn, "error": None})
            except ImageError as e:
                out.append({"content": None, "width": None, "height": None, "scale": None, "exif_rotation": None, "error": str(e)})
        kind = pa.struct([("content", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("scale", pa.float64()), ("exif_rotation", pa.int32()), ("error", pa.string())])
        return pa.array(out, kind)

    return run(content)


def thumbnail(content: Column, side: int = THUMBNAIL, make: Callable[[], Codec] = codec) -> Column:
    """A small upright picture for a review page; null where the image cannot be read."""
    return prepared(content, side, make)["content"]
