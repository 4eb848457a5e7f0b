"""Polygons from vertices and lines: faces, keys of rings, duplicates, order by position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .graph import cycles

#: Signed area that a face must exceed; the outer face has a negative one.
LEAST_AREA = 1e-6


def canonical_ring(ids: Column) -> Column:
    """The smallest rotation of a ring of ids, found in a time that grows with its length; null ids count as smallest.

    It begins at the smallest id. If that repeats, two starts are compared as
    far as they agree; the loser and as many starts after it as agreed are out.
    """
    return F.transform(F.array(ids), _least_rotation)[0]  # so that `ids` is worked out once


def _least_rotation(ids: Column) -> Column:
    n = F.size(ids)
    least = F.array_min(ids)
    first = F.array_position(ids, least).cast("int")
    once = ~F.exists(ids, lambda v: v.isNull()) & (F.array_position(F.slice(ids, first + 1, n), least) == 0)
    at = lambda s, which: F.get(ids, F.pmod(s[which] + s["same"], n))
    state = lambda i, j, same: F.struct(i.alias("i"), j.alias("j"), same.alias("same"))

    def step(s: Column) -> Column:
        a, b = at(s, "i"), at(s, "j")
        further = s["same"] + 1
        larger = a.isNotNull() & (b.isNull() | (a > b))
        i, j = F.when(larger, s["i"] + further).otherwise(s["i"]), F.when(larger, s["j"]).otherwise(s["j"] + further)
        apart = state(i, F.when(i == j, j + 1).otherwise(j), F.lit(0))
        over = (s["i"] >= n) | (s["j"] >= n) | (s["same"] >= n)
        return F.when(over, s).when(a.eqNullSafe(b), state(s["i"], s["j"], further)).otherwise(apart)

    searched = F.aggregate(F.sequence(F.lit(1), 3 * n), state(F.lit(0), F.lit(1), F.lit(0)), lambda s, _: step(s), lambda s: F.least(s["i"], s["j"]))
    start = F.when(once, first - 1).otherwise(searched)
    return F.when(n > 0, F.concat(F.slice(ids, start + 1, n), F.slice(ids, F.lit(1), start))).otherwise(ids)


def polygon_key(ids: Column) -> Column:
    """Text `a:b:c:` of the canonical ring; rings that differ in direction have different keys."""
    return F.array_join(F.transform(canonical_ring(ids), lambda v: F.concat(v.cast("string"), F.lit(":"))), "")


def cycle_key(ids: Column) -> Column:
    """A key that neither start nor direction nor a repeated closing id changes."""
    n = F.size(ids)
    open_ids = F.when((n > 1) & (F.get(ids, 0) == F.get(ids, n - 1)), F.slice(ids, F.lit(1), n - 1)).otherwise(ids)
    return F.least(polygon_key(open_ids), polygon_key(F.reverse(open_ids)))


def counter_clockwise(ids: Column, signed_area: Column) -> Column:
    return F.when(signed_area < 0, F.reverse(ids)).otherwise(ids)


def half_edges(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """`snapshot_id`, `id` (o, d), `next`: both directions of each line, and the half-edge that follows it around its face.

    It is the one before the twin in the order of angles at the end. Repeated
    and degenerate lines count once or not at all; so do lines without vertices.
    """
    ends = lines.where("v1 <> v2").select("snapshot_id", F.explode(F.array(F.struct(F.col("v1").alias("o"), F.col("v2").alias("d")), F.struct(F.col("v2").alias("o"), F.col("v1").alias("d")))).alias("e"))
    ends = ends.select("snapshot_id", "e.o", "e.d").distinct()
    at = lambda c: vertices.select("snapshot_id", F.col("vertex_id").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
    placed = ends.join(at("o"), ["snapshot_id", "o"]).join(at("d"), ["snapshot_id", "d"])
    angle = F.pmod(F.atan2(F.col("y_d") - F.col("y_o"), F.col("x_d") - F.col("x_o")), F.lit(2 * math.pi))
    star = Window.partitionBy("snapshot_id", "o").orderBy("angle", "d")
    whole = star.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = placed.withColumn("angle", angle).withColumn("before", F.coalesce(F.lag("d").over(star), F.last("d").over(whole)))
    return before.select("snapshot_id", F.struct(F.col("d").alias("o"), F.col("o").alias("d")).alias("id"), F.struct(F.col("o").alias("o"), F.col("before").alias("d")).alias("next"))


def rings_of(steps: DataFrame) -> DataFrame:
    """`snapshot_id`, `vertex_ids` of each cycle of half-edges, from its smallest one on."""
    walked = cycles(steps).select("snapshot_id", "cycle", F.struct("place", F.col("id.o").alias("v")).alias("p"))
    rings = walked.groupBy("snapshot_id", "cycle").agg(F.array_sort(F.collect_list("p")).alias("ring"))
    return rings.select("snapshot_id", F.transform("ring", lambda p: p["v"]).alias("vertex_ids"))


def faces(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """`snapshot_id`, `polygon_id` (from 0, by position), `vertex_ids`, `area` of the bounded faces of a network of lines.

    Faces of fewer than three vertices or of no positive area are left out,
    repeated ones too.
    """
    rings = with_points(rings_of(half_edges(vertices, lines)).where(F.size("vertex_ids") >= 3), vertices)
    rings = rings.withColumn("area", geo.signed_area(F.col("ring"))).where(F.col("area") > LEAST_AREA)
    rings = rings.withColumn("vertex_ids", canonical_ring(F.col("vertex_ids"))).dropDuplicates(["snapshot_id", "vertex_ids"])
    return ordered(rings).select("snapshot_id", "polygon_id", "vertex_ids", "area")


def with_points(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """Add `ring`, the points of `vertex_ids`; rings with a missing vertex are left out."""
    flat = rings.select("snapshot_id", "vertex_ids", F.posexplode("vertex_ids").alias("pos", "vertex_id"))
    found = flat.join(vertices.select("snapshot_id", "vertex_id", "x", "y"), ["snapshot_id", "vertex_id"])
    points = found.groupBy("snapshot_id", "vertex_ids").agg(F.array_sort(F.collect_set(F.struct("pos", F.col("vertex_id").alias("v"), "x", "y"))).alias("ring"))
    return points.where(F.size("ring") == F.size("vertex_ids"))


def ordered(rings: DataFrame) -> DataFrame:
    """Add `polygon_id` from 0 in each snapshot: by the ring's topmost point, then its leftmost, then its ids."""
    top = F.array_min(F.transform("ring", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    window = Window.partitionBy("snapshot_id").orderBy("_top", "vertex_ids")
    return rings.withColumn("_top", top).withColumn("polygon_id", F.row_number().over(window) - 1).drop("_top")


def ordered_by_points(rings: DataFrame) -> DataFrame:
    """Add `polygon_id` from 0 in each snapshot: by all points of the ring from the topmost on, a ring that another begins with first, then its ids."""
    points = F.array_sort(F.transform("ring", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    window = Window.partitionBy("snapshot_id").orderBy("_points", "vertex_ids")
    return rings.withColumn("_points", points).withColumn("polygon_id", F.row_number().over(window) - 1).drop("_points")


def id_list(text: Column) -> Column:
    """Three or more different whole numbers parted by commas, semicolons or white space; null for any other text."""
    parts = F.filter(F.split(text, r"[,;\s]+"), lambda p: p != "")
    ids = F.transform(parts, lambda p: p.try_cast("int"))
    good = (F.size(ids) >= 3) & ~F.exists(ids, lambda i: i.isNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, ids)


def polygons_of_vertices(polygons: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (`snapshot_id`, `vertex_ids`) with the `polygon_id` of each polygon of just those vertices, in whatever order."""
    key = lambda df: df.withColumn("_set", F.array_sort(F.array_distinct("vertex_ids")))
    return key(wanted).join(key(polygons).select("snapshot_id", "polygon_id", "_set"), ["snapshot_id", "_set"]).drop("_set")


def lines_between(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (`snapshot_id`, `v1`, `v2`) with the `line_id` of each line between those vertices, in either direction."""
    key = lambda df: df.withColumns({"_lo": F.least("v1", "v2"), "_hi": F.greatest("v1", "v2")})
    return key(wanted).join(key(lines).select("snapshot_id", "line_id", "_lo", "_hi"), ["snapshot_id", "_lo", "_hi"]).drop("_lo", "_hi")


def snapped(value: Column) -> Column:
    """A coordinate to three decimals, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 1000 + 0.5) / 1000 + 0.0


def snapped_vertices(points: DataFrame) -> DataFrame:
    """Points with the `vertex_id` they share if they agree to three decimals: from 0 in each snapshot, by place; `x`, `y` snapped."""
    at = points.withColumns({c: snapped(F.col(c)) for c in ("x", "y")})
    places = at.select("snapshot_id", "x", "y").distinct()
    number = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("y", "x")) - 1
    return at.drop("vertex_id").join(places.withColumn("vertex_id", number), ["snapshot_id", "x", "y"])


def polygons_from_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One polygon for each `snapshot_id` whose edges `v1`, `v2` form one simple cycle, counter-clockwise; others give none."""
    edges = edges.where("v1 <> v2").select("snapshot_id", F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2")).distinct()
    degree = edges.select("snapshot_id", F.explode(F.array("v1", "v2")).alias("v")).groupBy("snapshot_id", "v").agg(F.count("*").alias("degree"))
    simple = degree.groupBy("snapshot_id").agg(F.min("degree").alias("low"), F.max("degree").alias("high"), F.count("*").alias("n")).where("low = 2 and high = 2 and n >= 3")
    rings = with_points(rings_of(half_edges(vertices, edges.join(simple, "snapshot_id", "left_semi"))), vertices)
    rings = rings.withColumn("area", geo.signed_area(F.col("ring"))).where("area > 0").join(simple.select("snapshot_id", "n"), "snapshot_id")
    return rings.where(F.size("vertex_ids") == F.col("n")).select("snapshot_id", canonical_ring(F.col("vertex_ids")).alias("vertex_ids"), "area")


def polygons_from_vertices(vertices: DataFrame, lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """One polygon for each snapshot's `chosen` vertices: along its lines if they form a cycle of all, else by angle around the mean point."""
    key = ["snapshot_id", "vertex_id"]
    some = chosen.select(*key).distinct().join(vertices, key)
    between = lines
    for end in ("v1", "v2"):
        between = between.join(some.select("snapshot_id", F.col("vertex_id").alias(end)), ["snapshot_id", end], "left_semi")
    sizes = some.groupBy("snapshot_id").agg(F.count("*").alias("n")).where("n >= 3")
    along = polygons_from_edges(vertices, between).join(sizes, "snapshot_id").where(F.size("vertex_ids") == F.col("n")).select("snapshot_id", "vertex_ids")
    whole = Window.partitionBy("snapshot_id")
    angle = F.atan2(F.col("y") - F.avg("y").over(whole), F.col("x") - F.avg("x").over(whole))
    loose = some.join(sizes, "snapshot_id").join(along, "snapshot_id", "left_anti").withColumn("angle", angle)
    around = loose.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("angle", "vertex_id"))).alias("ring"))
    return along.union(around.select("snapshot_id", canonical_ring(F.transform("ring", lambda p: p["vertex_id"])).alias("vertex_ids")))


def distinct_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons without those that repeat an earlier one's ring in another start or direction; the smallest id stays."""
    window = Window.partitionBy("snapshot_id", "_key").orderBy("polygon_id")
    return polygons.withColumn("_key", cycle_key(F.col("vertex_ids"))).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_key", "_n")
