"""Geometry of text-probability maps in Arrow UDFs, and interfaces of what needs pixels or models."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIDE = 3.0
BOXES = "array<struct<quad:array<struct<x:double,y:double>>,score:double,width:double,height:double>>"


class Detector(Protocol):
    """Finds text lines."""

    def detect(self, pixels: np.ndarray) -> list[dict[str, Any]]:
        """quad and score of each line of an upright image (height, width, 3)."""
        ...


class Recognizer(Protocol):
    """Reads a line."""

    classes: list[str]

    def probabilities(self, pixels: np.ndarray) -> np.ndarray:
        """A row of class probabilities for each step; class 0 is blank."""
        ...


class CodeDecoder(Protocol):
    """Reads bar codes."""

    def decode(self, pixels: np.ndarray) -> list[dict[str, Any]]:
        """text, symbology, quad and angle of each code of an image."""
        ...


def components(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """8-connected components as (rows, columns), in the order of their first pixel; work follows runs, not pixels."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    label = np.arange(len(row))
    if len(row):
        # runs of neighbouring rows touch where they overlap or meet at a corner
        links = []
        begin = np.searchsorted(row, np.arange(mask.shape[0] + 1))
        for r in range(1, mask.shape[0]):
            up, down = np.arange(begin[r - 1], begin[r]), np.arange(begin[r], begin[r + 1])
            if len(up) and len(down):
                lo = np.searchsorted(last[up], first[down], "left")
                hi = np.searchsorted(first[up], last[down], "right")
                n = np.maximum(hi - lo, 0)
                links.append(np.stack([np.repeat(down, n), up[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]]))
        if links:
            a, b = np.concatenate(links, axis=1)
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
    out = []
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        n = last[at] - first[at]
        columns = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append((np.repeat(row[at], n), columns))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in (x, y), without points on its edges."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for q in seq:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], q - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(centre, width, height, angle) of the least rectangle around points; the angle, in radians in (-pi/2, pi/2], is that of the width.

    One side lies on a hull edge; among areas that are equal to six decimals the least height counts, then the first edge.
    """
    h = hull(points)
    if len(h) < 2:
        return h[0], 0.0, 0.0, 0.0
    edges = np.roll(h, -1, axis=0) - h
    best = None
    for ex, ey in edges.tolist():
        # quotients, not sines of an angle: sides along whole steps stay exact, so that equal areas are seen as such
        length = math.sqrt(ex * ex + ey * ey)
        c, s = ex / length, ey / length
        turned = np.stack([h[:, 0] * c + h[:, 1] * s, h[:, 1] * c - h[:, 0] * s], axis=1)
        low, high = turned.min(axis=0), turned.max(axis=0)
        width, height = (high - low).tolist()
        rank = round(width * height, 6), min(width, height)
        if best is None or rank < best[0]:
            middle = (low + high) / 2
            centre = np.array([middle[0] * c - middle[1] * s, middle[0] * s + middle[1] * c])
            best = (rank, centre, width, height, math.atan2(ey, ex))
    _, centre, width, height, angle = best
    if height > width:
        width, height, angle = height, width, angle + math.pi / 2
    angle = angle - math.pi * math.ceil((angle - math.pi / 2) / math.pi - 1e-12)
    return centre, float(width), float(height), float(angle)


def corners(centre: np.ndarray, width: float, height: float, angle: float) -> np.ndarray:
    """Four corners, clockwise on the screen from the one with the least x + y."""
    u = np.array([math.cos(angle), math.sin(angle)]) * width / 2
    v = np.array([-math.sin(angle), math.cos(angle)]) * height / 2
    quad = np.array([centre - u - v, centre + u - v, centre + u + v, centre - u + v])
    return np.roll(quad, -int(np.argmin(quad.sum(axis=1))), axis=0)


def boxes(probability: np.ndarray, threshold: float, box_threshold: float, unclip: float) -> list[tuple[np.ndarray, float]]:
    """(quad, score) of the text areas of a map: mean probability and least side decide, then boxes grow by area * unclip / perimeter."""
    return [(quad, score) for quad, score, _, _ in sized_boxes(probability, threshold, box_threshold, unclip)]


def sized_boxes(probability: np.ndarray, threshold: float, box_threshold: float, unclip: float) -> list[tuple[np.ndarray, float, float, float]]:
    """boxes() with the sides they grew to, which corners only give back rounded."""
    out = []
    for rows, columns in components(probability > threshold):
        score = float(probability[rows, columns].mean())
        if score < box_threshold:
            continue
        pixels = np.stack([columns, rows], axis=1)
        centre, width, height, angle = smallest_rectangle(np.concatenate([pixels + corner for corner in ((0, 0), (0, 1), (1, 0), (1, 1))]))
        if min(width, height) < MIN_SIDE:
            continue
        grow = width * height * unclip / (width + height)
        out.append((corners(centre, width + grow, height + grow, angle), score, width + grow, height + grow))
    return out


POINTS = "array<struct<x:double,y:double>>"


def _shapes(points: Column, shape: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A shape's corners for a column array<array<double>> of points."""

    @F.arrow_udf(POINTS)
    def run(column: pa.Array) -> pa.Array:
        out = [[{"x": float(x), "y": float(y)} for x, y in shape(np.array(p.as_py(), float))] if p.is_valid and len(p) else [] for p in column]
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return run(points)


def hulls(points: Column) -> Column:
    """hull() of each row's points."""
    return _shapes(points, hull)


def rectangles(points: Column) -> Column:
    """The corners of smallest_rectangle() around each row's points."""
    return _shapes(points, lambda p: corners(*smallest_rectangle(p)))


def map_components(rows: Column, threshold: float) -> Column:
    """components() of the cells above threshold, over a column array<array<double>> of maps."""

    @F.arrow_udf("array<struct<rows:array<int>,columns:array<int>>>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("rows", pa.list_(pa.int32())), ("columns", pa.list_(pa.int32()))]))
        maps = [np.array(m.as_py(), float) if m.is_valid and len(m) else np.zeros((0, 0)) for m in column]
        return pa.array([[{"rows": r.tolist(), "columns": c.tolist()} for r, c in components(m > threshold)] for m in maps], kind)

    return run(rows)


def map_boxes(rows: Column, threshold: float, box_threshold: float, unclip: float) -> Column:
    """sized_boxes() over a column array<array<double>> of maps."""

    @F.arrow_udf(BOXES)
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("quad", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("score", pa.float64()), ("width", pa.float64()), ("height", pa.float64())]))
        out = []
        for m in column:
            found = sized_boxes(np.array(m.as_py(), float), threshold, box_threshold, unclip) if m.is_valid and len(m) else []
            out.append([{"quad": [{"x": float(x), "y": float(y)} for x, y in q], "score": s, "width": w, "height": h} for q, s, w, h in found])
        return pa.array(out, kind)

    return run(rows)
