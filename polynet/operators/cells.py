"""Single-polygon geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.tables import dealt


def rings(vertices: DataFrame, polygons: DataFrame) -> DataFrame:
    """`snapshot_id`, `polygon_id`, `ring` in ring order; polygons with a missing vertex or under three are left out.

    Listed vertices are dealt, as those of very many polygons take few bytes.
    """
    flat = polygons.select("snapshot_id", "polygon_id", F.size("vertex_ids").alias("n"), F.posexplode("vertex_ids").alias("pos", "vertex_id"))
    found = dealt(flat, "snapshot_id", "vertex_id").join(vertices.select("snapshot_id", "vertex_id", "x", "y").hint("merge"), ["snapshot_id", "vertex_id"])
    one = F.struct("pos", F.col("vertex_id").alias("v"), "x", "y")
    whole = found.groupBy("snapshot_id", "polygon_id").agg(F.array_sort(F.collect_list(one)).alias("ring"), F.first("n").alias("n"))
    whole = whole.where((F.size("ring") == F.col("n")) & (F.col("n") >= 3))
    return whole.withColumn("ring", F.transform("ring", lambda p: F.struct(p["v"].alias("v"), p["x"].alias("x"), p["y"].alias("y")))).drop("n")


def cell_geometry(rings: DataFrame) -> DataFrame:
    """Area, perimeter, centroid, bounding box, aspect, circularity, vertex count; `hull_area` and `solidity` cost a UDF only if used."""
    ring = F.col("ring")
    out = rings.withColumn("edges", geo.edges(ring)).withColumn("signed_area", geo.signed_area(ring)).withColumn("area", F.abs("signed_area"))
    out = out.withColumn("perimeter", geo.perimeter(ring))
    cx, cy = geo.centroid(ring, F.col("signed_area"))
    (x0, x1), (y0, y1) = geo.extent(ring, "x"), geo.extent(ring, "y")
    out = out.withColumns({"cx": cx, "cy": cy, "x0": x0, "x1": x1, "y0": y0, "y1": y1})
    out = out.withColumn("aspect_ratio", geo.aspect(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return out.withColumn("circularity", geo.circularity(F.col("area"), F.col("perimeter"))).withColumn("vertex_count", F.size("ring"))


def with_solidity(cells: DataFrame) -> DataFrame:
    hull = cells.withColumn("hull_area", geo.hull_area(F.col("ring")))
    return hull.withColumn("solidity", F.when((F.col("area") > 0) & (F.col("hull_area") > 0), F.col("area") / F.col("hull_area")).otherwise(F.lit(geo.UNDEFINED)))


def single_cell_table(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Every cell's features and whether it is in a labelled pair."""
    ends = labels.select("snapshot_id", F.explode(F.array("first_id", "second_id")).alias("polygon_id")).distinct().withColumn("_in", F.lit(True))
    joined = with_solidity(cells).join(ends.hint("merge"), ["snapshot_id", "polygon_id"], "left")
    return joined.select("snapshot_id", "polygon_id", F.coalesce("_in", F.lit(False)).alias("in_dividing_pair"), "area", "perimeter", "aspect_ratio", "circularity", "solidity", "vertex_count")
