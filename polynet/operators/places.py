"""Points against networks: nearest vertex, polygon that holds a point, extents, counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import edges, extent


def nearest_vertex(points: DataFrame, vertices: DataFrame, tolerance: float, key: str = "point_id") -> DataFrame:
    """`snapshot_id`, `key`, `vertex_id`, `distance` of each point (`x`, `y`) that has a vertex within `tolerance`; ties to the smaller id.

    A tolerance of 0 or less asks for equal places. Points meet the vertices of
    the nine grid cells around them, cells as wide as the tolerance.
    """
    other = vertices.select("snapshot_id", "vertex_id", F.col("x").alias("vx"), F.col("y").alias("vy"))
    if tolerance <= 0:
        met = points.join(other.withColumns({"x": F.col("vx"), "y": F.col("vy")}).hint("merge"), ["snapshot_id", "x", "y"])
    else:
        cell = lambda c: F.floor(F.col(c) / tolerance)
        near = F.array(*[F.struct((cell("x") + i).alias("bx"), (cell("y") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = points.select("snapshot_id", key, "x", "y", F.explode(near).alias("b")).select("snapshot_id", key, "x", "y", "b.bx", "b.by")
        met = spread.join(other.withColumns({"bx": cell("vx"), "by": cell("vy")}).hint("merge"), ["snapshot_id", "bx", "by"])
    square = (F.col("vx") - F.col("x")) ** 2 + (F.col("vy") - F.col("y")) ** 2
    best = met.withColumn("d", square).where(F.col("d") <= max(tolerance, 0.0) ** 2).groupBy("snapshot_id", key).agg(F.min(F.struct("d", "vertex_id")).alias("best"))
    return best.select("snapshot_id", key, "best.vertex_id", F.sqrt("best.d").alias("distance"))


def holding_polygons(points: DataFrame, rings: DataFrame, cell: float | None = None, key: str = "point_id") -> DataFrame:
    """`snapshot_id`, `key`, `polygon_id` for each polygon that holds a point: an odd number of its edges lies to the point's right.

    Each polygon is laid into a grid whose cells are the power of two that its
    bounding box just fits into, so it lies in four cells at most, whatever its
    size; a point is looked up once in each grid in use. `cell` is the width of
    the finest grid, for tables whose polygons are much alike.
    """
    (x0, x1), (y0, y1) = extent(F.col("ring"), "x"), extent(F.col("ring"), "y")
    finest = math.ceil(math.log2(cell)) if cell else -20
    level = F.greatest(F.lit(finest), F.ceil(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(2.0**finest)))).cast("int"))
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level")))
    laid = rings.withColumn("level", level)
    levels = [r.level for r in laid.select("level").distinct().where("level is not null").collect()]  # exponents of numbers: at most some two thousand
    boxes = laid.withColumn("bx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("by", F.explode(F.sequence(at(y0), at(y1))))
    looked_up = points.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")))
    met = looked_up.withColumns({"bx": at(F.col("x")), "by": at(F.col("y"))}).join(boxes.hint("merge"), ["snapshot_id", "level", "bx", "by"])

    def crosses(e):
        spans = (e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))
        return spans & (F.col("x") < (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"])

    odd = F.size(F.filter(edges(F.col("ring")), crosses)) % 2 == 1
    return met.where(odd).select("snapshot_id", key, "polygon_id")


def extents(vertices: DataFrame, margin: float = 20.0, least: float = 10.0) -> DataFrame:
    """Drawing area of each snapshot: its vertices' bounding box with a margin, at least `least` wide and high."""
    box = vertices.groupBy("snapshot_id").agg(*[f(c).alias(f"{n}{c}") for f, n in ((F.min, "min_"), (F.max, "max_")) for c in ("x", "y")])
    size = lambda c: F.greatest(F.lit(least), F.col(f"max_{c}") - F.col(f"min_{c}") + 2 * margin)
    return box.select("snapshot_id", (F.col("min_x") - margin).alias("left"), (F.col("min_y") - margin).alias("top"), size("x").alias("width"), size("y").alias("height"))


def element_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each named table by snapshot, 0 where it has none."""
    each = [df.select("snapshot_id", *[F.lit(int(n == name)).alias(n) for n in tables]) for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.union(df)
    return out.groupBy("snapshot_id").agg(*[F.sum(n).cast("long").alias(n) for n in tables])
