"""Column expressions on polygon rings: arrays of (v, x, y) in ring order, open."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDEFINED = -1.0


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger, -1 where either is missing, not finite or not above 0."""
    ok = (a > 0) & (b > 0) & (a < math.inf) & (b < math.inf)
    return F.when(ok, F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(UNDEFINED))


def quotient(n: Column, d: Column) -> Column:
    """n / d, -1 where d is not above 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(UNDEFINED))


def edges(ring: Column) -> Column:
    """Ring edges (pos, v1, x1, y1, v2, x2, y2); the last goes back to the start."""
    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        return F.struct(i.alias("pos"), p["v"].alias("v1"), p["x"].alias("x1"), p["y"].alias("y1"), q["v"].alias("v2"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(ring, edge)


def total(items: Column, of) -> Column:
    """Sum in the items' order."""
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + of(e))


def cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def length(e: Column) -> Column:
    return F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"]))


def signed_area(ring: Column) -> Column:
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(total(edges(ring), cross) / 2)


def perimeter(ring: Column) -> Column:
    return F.when(F.size(ring) < 2, F.lit(0.0)).otherwise(total(edges(ring), length))


def centroid(ring: Column, area: Column) -> tuple[Column, Column]:
    """Weighted by area; the mean of the points where the ring has no area, the origin below three points."""
    out = []
    for c in ("x", "y"):
        weighted = total(edges(ring), lambda e, c=c: (e[f"{c}1"] + e[f"{c}2"]) * cross(e)) / F.when(F.abs(area) > 0, 6 * area)
        mean = total(ring, lambda p, c=c: p[c]) / F.size(ring)
        out.append(F.when(F.size(ring) < 3, F.lit(0.0)).when(F.abs(area) < 1e-12, mean).otherwise(weighted))
    return out[0], out[1]


def extent(ring: Column, c: str) -> tuple[Column, Column]:
    values = F.transform(ring, lambda p: p[c])
    return F.array_min(values), F.array_max(values)


def aspect(width: Column, height: Column) -> Column:
    """Of a bounding box, at least 1; -1 if a side is 0."""
    return F.when((width > 0) & (height > 0), F.greatest(width, height) / F.least(width, height)).otherwise(F.lit(UNDEFINED))


def circularity(area: Column, around: Column) -> Column:
    return F.when((area > 0) & (around > 0), 4 * math.pi * area / (around * around)).otherwise(F.lit(UNDEFINED))


def _hull(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull: lower and upper chain over sorted points, collinear points left out."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return 0.0

    def chain(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(points) + chain(points[::-1]))
    ahead = np.roll(ring, -1, axis=0)
    return float(abs((ring[:, 0] * ahead[:, 1] - ahead[:, 0] * ring[:, 1]).sum()) / 2)


@F.pandas_udf(T.DoubleType())
def _hull_area(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([_hull(np.asarray(a), np.asarray(b)) if a is not None else None for a, b in zip(x, y, strict=True)], dtype=float)


def hull_area(ring: Column) -> Column:
    """Area of the convex hull of a ring's points."""
    return _hull_area(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))


def to_segment(px: Column, py: Column, e: Column) -> Column:
    """Distance from a point to an edge as a segment."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.when(square > 0, square)))).otherwise(F.lit(0.0))
    qx, qy = e["x1"] + t * dx - px, e["y1"] + t * dy - py
    return F.sqrt(qx * qx + qy * qy)


def acute(degrees: Column) -> Column:
    """An angle between lines, brought to 0-90 degrees."""
    half = F.pmod(degrees, F.lit(180.0))
    return F.when(half <= 90, half).otherwise(180 - half)
