"""Networks from pixel tables (`snapshot_id`, `x`, `y` of foreground pixels of a skeleton)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import HOT_SHARE, forget, join_hot, keep, keep_observed
from .graph import reachable

KEY = ["snapshot_id", "x", "y"]
#: Side of a tile that one task connects, and a distance that holds the eight pixels around one alone.
TILE, BESIDE = 256, 1.5
#: Slices that the values of a group are cut into.
SLICES = 256
_NEAR = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def otsu(values: DataFrame, keys: list[str], value: str, slices: int = SLICES) -> DataFrame:
    """`keys`, `threshold`: the value that parts each group's values with the largest variance between the parts.

    Values up to the threshold are the lower part; ties go to the smallest
    value. Nulls are left out. Different values are counted, cut into `slices`
    of about as many by estimated quantiles, and added up within slices and
    then over them, so no task sees all values of a group.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counted, (rows, _) = keep_observed(counted, "counted")
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(10 * slices)).alias("_cuts")
    bounds = keep(counted.groupBy("_g").agg(cuts, F.count("*").alias("_rows")), "bounds")
    steps = F.array(*[F.lit(1 << i) for i in range(slices.bit_length() - 1, -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(F.col("_cuts"), done + step - 1) < F.col("v"), done + step).otherwise(done))
    sliced = keep(join_hot(counted, bounds, ["_g"], rows / HOT_SHARE, rows="_rows").select("_g", "v", "n", (F.col("n") * F.col("v")).alias("s"), part.alias("_slice")), "sliced")
    sums = sliced.groupBy("_g", "_slice").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select("_g", "_slice", before("n").alias("_n"), before("s").alias("_s"), F.sum("n").over(whole).alias("n1"), F.sum("s").over(whole).alias("s1"))
    below = Window.partitionBy("_g", "_slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    scanned = sliced.select("_g", "_slice", "v", F.sum("n").over(below).alias("n0"), F.sum("s").over(below).alias("s0")).join(sums, ["_g", "_slice"])
    scanned = scanned.withColumns({"n0": F.col("n0") + F.col("_n"), "s0": F.col("s0") + F.col("_s")})
    rest = F.col("n1") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - (F.col("s1") - F.col("s0")) / F.when(rest > 0, rest)
    scored = scanned.withColumn("score", F.coalesce(F.col("n0").cast("double") * rest * apart * apart, F.lit(0.0)))
    best = F.max_by("v", F.struct("score", -F.col("v")))
    return scored.groupBy("_g").agg(best.alias("threshold")).select("_g.*", "threshold")


def binarised(pixels: DataFrame, threshold: float | None = None, invert: bool = False) -> DataFrame:
    """Foreground of `snapshot_id`, `x`, `y`, `value`: values above the threshold (Otsu's of the snapshot if none is given)."""
    if threshold is None:
        cut = pixels.join(otsu(pixels, ["snapshot_id"], "value"), "snapshot_id")
    else:
        cut = pixels.withColumn("threshold", F.lit(threshold))
    above = F.col("value") > F.col("threshold")
    return cut.where(~above if invert else above).select(*KEY)


def _around(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """A row (`x`, `y`, `px`, `py`) for each of a pixel's neighbouring places: the eight around it, or all within `reach` along each axis."""
    steps = _NEAR if reach == 1 else [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if dx or dy]
    places = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])
    return pixels.select("snapshot_id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(places).alias("p")).select("snapshot_id", "p.x", "p.y", "px", "py")


def neighbour_counts(pixels: DataFrame) -> DataFrame:
    """Add `neighbours`: foreground pixels among the eight around each."""
    near = _around(pixels.select(*KEY)).repartition(*KEY).groupBy(*KEY).agg(F.count("*").alias("neighbours"))
    return pixels.join(near.hint("merge"), KEY, "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def junctions(pixels: DataFrame, width: int, height: int, exactly: int | None = None) -> DataFrame:
    """Foreground pixels off the border with three neighbours or more, or with just `exactly` so many."""
    n = F.col("neighbours")
    inside = F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)
    return neighbour_counts(pixels).where(inside & (n >= 3 if exactly is None else n == exactly))


def _close_pairs(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of points within `radius` of each other, enough of them to connect all that are connected.

    Points go into squares whose points all are within the radius; those of a
    square are linked one to the next, and met with those of squares near by.
    """
    side = radius / np.sqrt(2) * (1 - 1e-9)
    bx, by = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    bx, by = bx - bx.min(), by - by.min()
    wide = int(bx.max()) + 5
    square = by * wide + bx
    order = np.argsort(square, kind="stable")
    square = square[order]
    same = np.flatnonzero(square[1:] == square[:-1])
    first, second = [order[same]], [order[same + 1]]
    for step in (1, 2, *(dy * wide + dx for dy in (1, 2) for dx in range(-2, 3))):
        low, high = np.searchsorted(square, square + step), np.searchsorted(square, square + step, side="right")
        n = high - low
        a, b = np.repeat(np.arange(len(order)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = order[a], order[b]
        ok = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius * radius
        first.append(a[ok])
        second.append(b[ok])
    return np.concatenate(first), np.concatenate(second)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that pairs (a, b) connect each of `n` points to."""
    low = np.arange(n)
    while True:
        u, v = low[a], low[b]
        if (u == v).all():
            return low
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]


def connected(points: DataFrame, radius: float, side: int | None = None) -> DataFrame:
    """`snapshot_id`, `x`, `y`, `component` (its first point, as `y`, `x`) and `tile` of distinct points: those within `radius` of each other, taken on.

    Tiles of `side` (`TILE` if not given) by `side` are connected within a task each; only points
    close to a tile's border meet those of other tiles, and only their parts
    go through rounds of joins.
    """
    side = side or TILE
    tile = lambda c: F.floor(F.col(c) / side)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"snapshot_id {kinds['snapshot_id']}, tile_x long, tile_y long, x {kinds['x']}, y {kinds['y']}, part_y {kinds['y']}, part_x {kinds['x']}"

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        low = _joined(len(pdf), *_close_pairs(pdf.x.to_numpy(float), pdf.y.to_numpy(float), radius))
        pdf["part_y"], pdf["part_x"] = pdf.y.to_numpy()[low], pdf.x.to_numpy()[low]
        return pdf

    own = points.select("snapshot_id", "x", "y").where("x is not null and y is not null").distinct().withColumns({"tile_x": tile("x"), "tile_y": tile("y")})
    local = own.select("snapshot_id", "tile_x", "tile_y", "x", "y").groupBy("snapshot_id", "tile_x", "tile_y").applyInPandas(parts, schema)
    local = keep(local.withColumn("part", F.struct(F.col("part_y").alias("y"), F.col("part_x").alias("x"))).drop("part_y", "part_x"), "parts")

    edge = lambda c: (F.col(c) - F.col(f"tile_{c}") * side < radius) | ((F.col(f"tile_{c}") + 1) * side - F.col(c) <= radius)
    border = local.where(edge("x") | edge("y")).withColumns({"bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    places = F.array(*[F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by")) for dx, dy in [(0, 0), *_NEAR]])
    wide = border.select("snapshot_id", "tile_x", "tile_y", "x", "y", F.col("part").alias("u"), F.explode(places).alias("b")).select("*", "b.bx", "b.by").drop("b")
    other = border.select("snapshot_id", "bx", "by", *[F.col(c).alias(f"_{c}") for c in ("tile_x", "tile_y", "x", "y")], F.col("part").alias("v"))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    met = wide.join(other.hint("merge"), ["snapshot_id", "bx", "by"]).where((F.struct("tile_x", "tile_y") < F.struct("_tile_x", "_tile_y")) & (dx * dx + dy * dy <= radius * radius))
    low = reachable(met.select("snapshot_id", "u", "v").distinct(), ("snapshot_id",)).withColumnRenamed("id", "part")
    out = local.join(low.hint("merge"), ["snapshot_id", "part"], "left")
    return out.select("snapshot_id", "x", "y", F.coalesce("low", "part").alias("component"), F.struct("tile_x", "tile_y").alias("tile"))


def clusters(points: DataFrame, radius: float = 2.0) -> DataFrame:
    """Add `vertex_id` (from 0, by place), `vx`, `vy`: points within `radius` of each other, taken on, and their rounded mean."""
    found = keep(connected(points, radius).drop("tile"), "found")
    middle = found.groupBy("snapshot_id", "component").agg(*[F.bround(F.avg(c)).cast("int").alias(f"v{c}") for c in ("x", "y")])
    number = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("vy", "vx", "component")) - 1
    named = middle.withColumn("vertex_id", number)
    return found.join(named.hint("merge"), ["snapshot_id", "component"]).select("snapshot_id", "x", "y", "vertex_id", "vx", "vy")


def _peeled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True for pixels that stay when those with just one neighbour are dropped, all at once, until none has."""
    at = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
    near = [[at[q] for dx, dy in _NEAR if (q := (px + dx, py + dy)) in at] for px, py in at]
    count, there = [len(n) for n in near], [True] * len(near)
    ends = [i for i, n in enumerate(count) if n == 1]
    while ends:
        for i in ends:
            there[i] = False
        touched = {j for i in ends for j in near[i] if there[j]}
        for i in ends:
            for j in near[i]:
                count[j] -= 1
        ends = [j for j in touched if count[j] == 1]
    return np.array(there, bool)


def _in_cycles(pixels: DataFrame) -> DataFrame:
    """Pixels left of components that have a cycle: each round takes all chains that end, from their ends to where they branch."""
    left, (n, _) = keep_observed(pixels, "pixels")
    while n:
        counted = keep(neighbour_counts(left), "counted")
        ends = counted.where("neighbours = 1").select(*KEY)
        if ends.isEmpty():
            break
        chains = keep(connected(counted.where("neighbours <= 2"), BESIDE).select(*KEY, "component"), "chains")
        gone = chains.join(ends.hint("merge"), KEY, "left_semi").select("snapshot_id", "component").distinct()
        old = left
        left, (n, _) = keep_observed(left.join(chains.join(gone.hint("merge"), ["snapshot_id", "component"], "left_semi").hint("merge"), KEY, "left_anti"), "pixels")
        forget(old, counted, chains)
    return left


def without_spurs(pixels: DataFrame) -> DataFrame:
    """Pixels that stay when those with just one neighbour are dropped, all at once, until none has.

    Of a component with a cycle the pixels in cycles and between them stay:
    rounds grow with the logarithm of the branches of its spurs, whatever their
    lengths. Of one without a cycle the middle pixel stays, if there is one:
    such components are worked on within a task if one tile holds them, others
    by a round for each pixel of half their length.
    """
    found = keep(connected(pixels, BESIDE), "found")
    degrees = found.select(*KEY, "component", "tile").join(neighbour_counts(found.select(*KEY)).hint("merge"), KEY)
    kinds = degrees.groupBy("snapshot_id", "component").agg((F.sum("neighbours") == 2 * (F.count("*") - 1)).alias("tree"), F.min("tile").alias("low"), F.max("tile").alias("high"))
    kinds = keep(kinds.withColumn("within", F.col("low") == F.col("high")).drop("low", "high"), "kinds")
    placed = keep(found.join(kinds.hint("merge"), ["snapshot_id", "component"]), "placed")
    forget(found, kinds)
    out = _in_cycles(placed.where("not tree").select(*KEY))
    kind = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    small = placed.where("tree and within").groupBy("snapshot_id", "tile").applyInPandas(lambda pdf: pdf.loc[_peeled(pdf.x.to_numpy(), pdf.y.to_numpy()), KEY], ", ".join(f"{c} {kind[c]}" for c in KEY))
    left, (n, _) = keep_observed(placed.where("tree and not within").select(*KEY), "pixels")
    before = None
    while n != before:
        old, before = left, n
        left, (n, _) = keep_observed(neighbour_counts(left).where("neighbours <> 1").select(*KEY), "pixels")
        forget(old)
    return out.unionByName(small).unionByName(left)


def traced_lines(pixels: DataFrame, members: DataFrame, tolerance: int = 1) -> DataFrame:
    """`snapshot_id`, `v1`, `v2`: vertices that a path of skeleton pixels connects. `members`: result of `clusters`.

    A path is an 8-connected run of pixels that are in no cluster, and it ends
    at the clusters that it touches, whose pixels are within `tolerance` of its own; one that touches more than two gives all
    their pairs.
    """
    free = keep(pixels.select(*KEY).distinct().join(members.select(*KEY).hint("merge"), KEY, "left_anti"), "paths")
    paths = connected(free, BESIDE).select(*KEY, F.col("component").alias("path"))
    ends = _around(members.select(*KEY, "vertex_id"), tolerance).join(members.select("snapshot_id", F.col("x").alias("px"), F.col("y").alias("py"), "vertex_id").hint("merge"), ["snapshot_id", "px", "py"])
    touched = keep(ends.join(paths.hint("merge"), KEY).select("snapshot_id", "path", "vertex_id").distinct(), "ends")
    pairs = touched.withColumnRenamed("vertex_id", "v1").join(touched.withColumnRenamed("vertex_id", "v2").hint("merge"), ["snapshot_id", "path"])
    return pairs.where("v1 < v2").select("snapshot_id", "v1", "v2").distinct()
