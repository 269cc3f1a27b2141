"""Quads, boxes and angles as column expressions; points are struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The clockwise turn of each EXIF orientation 1 to 8.
EXIF_TURNS = (0, 0, 180, 180, 90, 90, 270, 270)


def point(x: Column, y: Column) -> Column:
    """struct<x, y>."""
    return F.struct(x.alias("x"), y.alias("y"))


def exif_turn(orientation: Column) -> Column:
    """Degrees for an EXIF orientation; 0 where it is none."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, EXIF_TURNS)), F.when(orientation.between(1, 8), orientation)), F.lit(0))


def scaled(quad: Column, scale: Column) -> Column:
    """Points times scale, to one decimal."""
    return F.transform(quad, lambda p: point(F.round(p["x"] * scale, 1), F.round(p["y"] * scale, 1)))


def rotated(quad: Column, turn: Column) -> Column:
    """The four corners, starting turn / 90 later."""
    k = F.pmod(F.floor(turn / 90).cast("int"), F.lit(4))
    return F.concat(F.slice(quad, k + 1, 4), F.slice(quad, F.lit(1), k))


def box_quad(x0: Column, y0: Column, x1: Column, y1: Column, turn: Column) -> Column:
    """The corners of an upright box, clockwise from the corner where its turned text starts."""
    return rotated(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)), turn)


def top_edge_angle(quad: Column) -> Column:
    """Clockwise degrees of the first edge, in [0, 360)."""
    a, b = F.element_at(quad, 1), F.element_at(quad, 2)
    return F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(360.0))


def turned_angle(base: Column, turn: Column) -> Column:
    """Floored sum of angles in [0, 360)."""
    return F.pmod(base + turn, F.lit(360.0))


def pixel_box(numbers: Column, box_format: str, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1> in pixels inside the image, or null where less than a pixel is left.

    numbers: four doubles as the format orders them: pixels_xyxy, normalized_xyxy
    or normalized_yxyx (thousandths of the image).
    """
    if box_format not in ("pixels_xyxy", "normalized_xyxy", "normalized_yxyx"):
        raise ValueError(f"unknown box format {box_format!r}")
    order = (1, 0, 3, 2) if box_format == "normalized_yxyx" else (0, 1, 2, 3)
    raw = [F.get(numbers, F.lit(i)) for i in order]
    if box_format != "pixels_xyxy":
        raw = [v * side / 1000 for v, side in zip(raw, (width, height, width, height), strict=True)]
    x0, y0, x1, y1 = (F.least(F.greatest(v, F.lit(0.0)), side.cast("double")) for v, side in zip(raw, (width, height, width, height), strict=True))
    box = [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = (F.size(numbers) == 4) & finite & (box[2] - box[0] >= 1) & (box[3] - box[1] >= 1)
    return F.when(ok, F.struct(*(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True))))


def padded_crop(quad: Column, padding: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1>: the upright box around a quad, padded, inside the image."""
    xs, ys = (F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"]))
    return F.struct(
        F.greatest(F.array_min(xs) - padding, F.lit(0.0)).alias("x0"), F.greatest(F.array_min(ys) - padding, F.lit(0.0)).alias("y0"),
        F.least(F.array_max(xs) + padding, width.cast("double")).alias("x1"), F.least(F.array_max(ys) + padding, height.cast("double")).alias("y1"),
    )
