"""Geometric features of neighbouring polygons: 49 columns, each an expression on the two cells.

Missing ratios are -1 and pass a "below" rule, as other missing values (null) do
not. Two neighbours have disjoint insides. Where they share one chain of edges,
the union's area, outline, centroid and boundary follow from the two rings; where
they meet along several, its rings are walked, and each hole between the cells is a
ring of its own. Rings count by their own areas, holes too, as the published tables have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .adjacency import with_cells

#: Family of mean, minimum, maximum and difference: feature name, ratio's name, cell column.
STATS = (
    ("area", "areaRatio", "area"),
    ("perimeter", "perimeterRatio", "perimeter"),
    ("aspect", "aspectRatio", "aspect_ratio"),
    ("circularity", "circularityRatio", "circularity"),
    ("solidity", "solidityRatio", "solidity"),
    ("vertexCount", "vertexCountRatio", "vertex_count"),
)


def pair_stats() -> dict[str, Column]:
    """Ratio and stats of both cells' values, and their centroids' distance."""
    out: dict[str, Column] = {}
    for name, ratio, column in STATS:
        a, b = F.col(f"a.{column}").cast("double"), F.col(f"b.{column}").cast("double")
        out |= {ratio: geo.ratio(a, b), f"{name}Mean": (a + b) / 2, f"{name}Min": F.least(a, b), f"{name}Max": F.greatest(a, b), f"{name}Diff": F.abs(a - b)}
    dx, dy = F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")
    distance = F.sqrt(dx * dx + dy * dy)
    return out | {"centroidDistance": distance, "centroidDistanceNormalized": _per_size(distance)}


def _size() -> Column:
    return (F.sqrt("a.area") + F.sqrt("b.area")) / 2


def _per_size(value: Column) -> Column:
    return F.when(_size() > 0, value / _size())


def _same(e: Column, f: Column) -> Column:
    return ((e["v1"] == f["v1"]) & (e["v2"] == f["v2"])) | ((e["v1"] == f["v2"]) & (e["v2"] == f["v1"]))


def joined_pairs(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs with both cells, `shared` edges in ring order of the first, and the `longest` of them (null: none)."""
    out = with_cells(pairs, cells)
    out = out.withColumn("shared", F.filter("a.edges", lambda e: F.exists("b.edges", lambda f: _same(e, f))))
    best = F.array_max(F.transform("shared", lambda e: F.struct(geo.length(e).alias("length"), (-e["pos"]).alias("order"), e.alias("edge"))))
    return out.withColumn("longest", best["edge"]).withColumn("sharedEdgeLength", F.when(F.size("shared") > 0, geo.total(F.col("shared"), geo.length)))


def shared_edge() -> dict[str, Column]:
    """Lengths of shared edges and distances to the longest one."""
    e = F.col("longest")
    off = F.filter(F.concat("a.ring", "b.ring"), lambda p: (p["v"] != e["v1"]) & (p["v"] != e["v2"]))
    mean = geo.total(off, lambda p: geo.to_segment(p["x"], p["y"], e)) / F.when(F.size(off) > 0, F.size(off))
    middle = (geo.to_segment(F.col("a.cx"), F.col("a.cy"), e) + geo.to_segment(F.col("b.cx"), F.col("b.cy"), e)) / 2
    known = lambda c: F.when(e.isNotNull(), c)
    return {
        "sharedEdgeLength": F.col("sharedEdgeLength"),
        "normalizedSharedEdgeLength": F.coalesce(_per_size(F.col("sharedEdgeLength")), F.lit(geo.UNDEFINED)),
        "sharedEdgeUnsharedVerticesDistance": known(mean),
        "sharedEdgeUnsharedVerticesDistanceNormalized": known(_per_size(mean)),
        "centroidSharedEdgeDistance": known(middle),
        "centroidSharedEdgeDistanceNormalized": known(_per_size(middle)),
    }


def union_shape() -> dict[str, Column]:
    """Shape of both cells taken together, and how it lies to the longest shared edge."""
    e, several = F.col("longest"), F.col("several")
    size = lambda r: F.abs(r["signed"])
    area = F.when(several, geo.total(F.col("outlines"), size)).otherwise(F.col("a.area") + F.col("b.area"))
    around = F.col("a.perimeter") + F.col("b.perimeter") - 2 * F.coalesce("sharedEdgeLength", F.lit(0.0))
    weighted = {c: F.when(several, geo.total(F.col("outlines"), lambda r, c=c: r[f"m{c}"] * F.signum(r["signed"]) / 6)).otherwise(F.col("a.area") * F.col(f"a.c{c}") + F.col("b.area") * F.col(f"b.c{c}")) for c in ("x", "y")}
    cx, cy = (weighted[c] / F.when(area > 0, area) for c in ("x", "y"))
    wide = lambda c: F.greatest(f"a.{c}1", f"b.{c}1") - F.least(f"a.{c}0", f"b.{c}0")
    hull = geo.hull_area(F.concat("a.ring", "b.ring"))
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    run = F.sqrt(dx * dx + dy * dy)
    from_line = F.abs(dx * (e["y1"] - cy) - dy * (e["x1"] - cx)) / F.when(run > 0, run)
    axis = F.degrees(F.atan2(2 * F.col("moments.sxy"), F.col("moments.sxx") - F.col("moments.syy")) / 2)
    return {
        "unionAspectRatio": geo.aspect(wide("x"), wide("y")),
        "unionCircularity": geo.circularity(area, around),
        "unionConvexDeficiency": F.when(area > 0, (hull - area) / area).otherwise(F.lit(geo.UNDEFINED)),
        "sharedEdgeUnionCentroidDistance": F.when(e.isNotNull(), from_line),
        "sharedEdgeUnionCentroidDistanceNormalized": F.when(e.isNotNull(), _per_size(from_line)),
        "sharedEdgeUnionAxisAngleDegrees": F.when(e.isNotNull(), geo.acute(F.degrees(F.atan2(dy, dx)) - axis)),
    }


def with_outlines(pairs: DataFrame) -> DataFrame:
    """Add `border`: the edges of one cell alone, each with its `cell`, in counter-clockwise direction; `several`: the cells meet at more than one place; and then `outlines`.

    `outlines` has (`signed`, `around`, `mx`, `my`) of each ring of the union, anticlockwise ones with positive areas: area, length and
    sums that make the centroid. It is null unless `several`. From an edge the walk goes on at its end, to the other cell's edge
    where both cells have one there, so that a hole which touches the outline at a vertex is still a ring of its own.
    Rings are told apart by pointer doubling over the row's border. Cells that overlap give rings of no meaning, without an error.
    """

    def turned(side: str, cell: int) -> Column:
        fields = lambda e, i, j: F.struct(F.lit(cell).alias("cell"), *[e[f"{c}{k}"].alias(f"{c}{n}") for k, n in ((i, 1), (j, 2)) for c in ("v", "x", "y")])
        edges, back = F.col(f"{side}.edges"), F.col(f"{side}.signed_area") < 0
        return F.when(back, F.transform(edges, lambda e: fields(e, 2, 1))).otherwise(F.transform(edges, lambda e: fields(e, 1, 2)))

    ids = lambda side: F.transform(f"{side}.ring", lambda p: p["v"])
    places = F.size(F.array_intersect(ids("a"), ids("b"))) - F.size("shared")  # a chain has one vertex more than edges
    out = pairs.withColumn("border", F.filter(F.concat(turned("a", 0), turned("b", 1)), lambda f: ~F.exists("shared", lambda g: _same(f, g))))
    out = out.withColumn("several", (places > 1) & (F.size("border") > 0))
    border, every = F.col("border"), F.sequence(F.lit(0), F.size("border") - 1)

    def follower(e: Column, i: Column) -> Column:
        after = F.filter(every, lambda j: F.get(border, j)["v1"] == e["v2"])
        across = F.filter(after, lambda j: F.get(border, j)["cell"] != e["cell"])
        return F.coalesce(F.get(across, 0), F.get(after, 0), i)

    doubled = lambda s, _: F.struct(
        F.transform(s["jump"], lambda j: F.get(s["jump"], j)).alias("jump"),
        F.transform(s["low"], lambda low, i: F.least(low, F.get(s["low"], F.get(s["jump"], i)))).alias("low"),
    )
    out = out.withColumn("_next", F.when(F.col("several"), F.transform(border, follower)))
    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size("border"))))
    low = F.aggregate(rounds, F.struct(F.col("_next").alias("jump"), every.alias("low")), doubled, lambda s: s["low"])
    out = out.withColumn("_low", F.when(F.col("several"), low))

    def outline(r: Column) -> Column:
        own = F.filter(border, lambda _, i: F.get("_low", i) == r)
        moment = lambda c: geo.total(own, lambda e: (e[f"{c}1"] + e[f"{c}2"]) * geo.cross(e))
        return F.struct((geo.total(own, geo.cross) / 2).alias("signed"), geo.total(own, geo.length).alias("around"), moment("x").alias("mx"), moment("y").alias("my"))

    return out.withColumn("outlines", F.transform(F.array_distinct("_low"), outline)).drop("_next", "_low")


def union_rings(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """`snapshot_id`, `first_id`, `second_id`, `ring` (from 1), `area`, `perimeter`, `is_hole` of the rings of pairs that meet at more than one place, largest first.

    Two cells that touch at one vertex, or share one chain of edges, have a single ring; they give no rows. An empty table gives none.
    """
    found = with_outlines(joined_pairs(pairs, cells)).where("several")
    ring = F.transform("outlines", lambda r: F.struct(F.abs(r["signed"]).alias("area"), r["around"].alias("perimeter"), (r["signed"] < 0).alias("is_hole")))
    each = found.select("snapshot_id", "first_id", "second_id", F.posexplode(F.reverse(F.array_sort(ring))).alias("ring", "r"))
    return each.select("snapshot_id", "first_id", "second_id", (F.col("ring") + 1).alias("ring"), "r.*")


def with_moments(pairs: DataFrame) -> DataFrame:
    """Add `with_outlines`' columns and `moments`: second central moments of the points on the union's rings; a point where two rings touch counts in both."""
    out = with_outlines(pairs)
    out = out.withColumn("points", F.transform("border", lambda f: F.struct(f["x1"].alias("x"), f["y1"].alias("y"))))
    n = F.when(F.size("points") > 0, F.size("points"))
    out = out.withColumns({f"mean_{c}": geo.total(F.col("points"), lambda p, c=c: p[c]) / n for c in ("x", "y")})
    moment = lambda u, v: geo.total(F.col("points"), lambda p: (p[u] - F.col(f"mean_{u}")) * (p[v] - F.col(f"mean_{v}")))
    return out.withColumn("moments", F.struct(moment("x", "x").alias("sxx"), moment("y", "y").alias("syy"), moment("x", "y").alias("sxy")))


def with_angles(pairs: DataFrame) -> DataFrame:
    """Add `angles`: at each shared vertex, between the two edges that lead away from the pair's border."""
    ids = lambda side: F.transform(f"{side}.ring", lambda p: p["v"])
    pairs = pairs.withColumns({"ids_a": ids("a"), "ids_b": ids("b")}).withColumn("common", F.array_intersect("ids_a", "ids_b"))

    def away(side: str, v: Column) -> Column:
        """The one ring neighbour of v that is not shared, if just one is not."""
        ring, n = F.col(f"{side}.ring"), F.size(f"{side}.ring")
        at = F.array_position(f"ids_{side}", v).cast("int") - 1
        back, ahead = F.get(ring, (at + n - 1) % n), F.get(ring, (at + 1) % n)
        b, a = F.array_contains("common", back["v"]), F.array_contains("common", ahead["v"])
        return F.when(b & ~a, ahead).when(a & ~b, back)

    ends = F.transform("common", lambda v: F.struct(F.get("a.ring", F.array_position("ids_a", v).cast("int") - 1).alias("o"), away("a", v).alias("p"), away("b", v).alias("q")))
    pairs = pairs.withColumn("ends", F.filter(ends, lambda e: e["p"].isNotNull() & e["q"].isNotNull()))

    def angle(e: Column) -> Column:
        o, p, q = e["o"], e["p"], e["q"]
        ux, uy, wx, wy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"]
        return F.degrees(F.abs(F.atan2(ux * wy - uy * wx, ux * wx + uy * wy)))

    return pairs.withColumn("angles", F.transform("ends", angle))


def junction_angles() -> dict[str, Column]:
    """Statistics of the angles at the shared vertices."""
    angles = F.col("angles")
    n = F.when(F.size(angles) > 0, F.size(angles))
    low, high = F.array_min(angles), F.array_max(angles)
    return {
        "junctionAngleAverageDegrees": geo.total(angles, lambda x: x) / n,
        "junctionAngleMaxDegrees": high,
        "junctionAngleMinDegrees": low,
        "junctionAngleDifferenceDegrees": high - low,
        "junctionAngleRatio": F.when(high > 0, low / high),
    }


FAMILIES = {"stats": pair_stats, "shared_edge": shared_edge, "union": union_shape, "junction": junction_angles}
#: What families need beside both cells.
NEEDS = {"union": with_moments, "junction": with_angles}


def pair_features(pairs: DataFrame, cells: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """`snapshot_id`, `first_id`, `second_id` and the features of the given families. Unused ones are pruned with what they need.

    Spark takes cells through joins and sorts whole, also if one field is used, so those for angles alone are cut down to their rings before.
    """
    only_rings = set(families) <= {"junction"}
    joined, columns = with_cells(pairs, cells.select("snapshot_id", "polygon_id", "ring")) if only_rings else joined_pairs(pairs, cells), {}
    for f in families:
        joined = NEEDS[f](joined) if f in NEEDS else joined
        columns |= FAMILIES[f]()
    return joined.select("snapshot_id", "first_id", "second_id", *[c.alias(name) for name, c in columns.items()])
