"""Checks and edits of the vertices, lines and polygons of many snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Undirected boundary edges (`v1` < `v2`) of each polygon."""
    n, ids = F.size("vertex_ids"), F.col("vertex_ids")
    pair = F.transform(ids, lambda v, i: F.struct(F.least(v, F.get(ids, (i + 1) % n)).alias("v1"), F.greatest(v, F.get(ids, (i + 1) % n)).alias("v2")))
    return polygons.select("snapshot_id", "polygon_id", F.explode(pair).alias("e")).select("snapshot_id", "polygon_id", "e.v1", "e.v2")


def _undirected(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"v1": F.least("v1", "v2"), "v2": F.greatest("v1", "v2")})


def suspect_vertices(vertices: DataFrame, lines: DataFrame, polygons: DataFrame) -> DataFrame:
    """Vertices with fewer than two lines or in no polygon: `degree`, `in_polygon`."""
    ends = lines.select("snapshot_id", F.explode(F.array("v1", "v2")).alias("vertex_id")).groupBy("snapshot_id", "vertex_id").agg(F.count("*").alias("degree"))
    used = polygons.select("snapshot_id", F.explode("vertex_ids").alias("vertex_id")).distinct().withColumn("in_polygon", F.lit(True))
    key = ["snapshot_id", "vertex_id"]
    out = vertices.select(*key).join(ends, key, "left").join(used, key, "left")
    out = out.select(*key, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("in_polygon", F.lit(False)).alias("in_polygon"))
    return out.where((F.col("degree") <= 1) | ~F.col("in_polygon"))


def suspect_lines(lines: DataFrame, polygons: DataFrame) -> DataFrame:
    """Lines on no polygon's boundary."""
    return _undirected(lines).join(ring_edges(polygons), ["snapshot_id", "v1", "v2"], "left_anti")


def missing_lines(lines: DataFrame, polygons: DataFrame) -> DataFrame:
    """Boundary edges that have no line."""
    return ring_edges(polygons).select("snapshot_id", "v1", "v2").distinct().join(_undirected(lines), ["snapshot_id", "v1", "v2"], "left_anti")


def without_vertices(lines: DataFrame, polygons: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and polygons that stay when vertices are deleted."""
    key = gone.select("snapshot_id", "vertex_id").distinct()
    for end in ("v1", "v2"):
        lines = lines.join(key.withColumnRenamed("vertex_id", end), ["snapshot_id", end], "left_anti")
    hit = polygons.select("snapshot_id", "polygon_id", F.explode("vertex_ids").alias("vertex_id")).join(key, ["snapshot_id", "vertex_id"], "left_semi")
    return lines, polygons.join(hit.select("snapshot_id", "polygon_id").distinct(), ["snapshot_id", "polygon_id"], "left_anti")


def without_lines(polygons: DataFrame, gone: DataFrame) -> DataFrame:
    """Polygons that stay when lines are deleted."""
    hit = ring_edges(polygons).join(_undirected(gone), ["snapshot_id", "v1", "v2"], "left_semi")
    return polygons.join(hit.select("snapshot_id", "polygon_id").distinct(), ["snapshot_id", "polygon_id"], "left_anti")


def line_geometry(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """Length, mid-point, angle (0-180) and acute angle (0-90) of each line."""
    at = lambda end: vertices.select("snapshot_id", F.col("vertex_id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))
    out = lines.join(at("v1"), ["snapshot_id", "v1"]).join(at("v2"), ["snapshot_id", "v2"])
    dx, dy = F.col("x_v2") - F.col("x_v1"), F.col("y_v2") - F.col("y_v1")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return out.select("snapshot_id", "v1", "v2", F.sqrt(dx * dx + dy * dy).alias("length"), ((F.col("x_v1") + F.col("x_v2")) / 2).alias("mid_x"), ((F.col("y_v1") + F.col("y_v2")) / 2).alias("mid_y"), angle.alias("angle"), F.when(angle <= 90, angle).otherwise(180 - angle).alias("acute_angle"))
