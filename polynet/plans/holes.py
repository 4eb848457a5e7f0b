"""Registered queries on walls some of whose neighbours meet along several chains, with holes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjacency import neighbours
from ..operators.cells import cell_geometry, rings
from ..operators.features import pair_features, union_rings
from ..sources.mesh import Network, mesh
from .catalogue import _MESH, PAIR, _r, query, whole_sides

#: The wall with a hole between the cells 5r and 5r + 1, 5r + 2 and 5r + 3 of each row; every third hole begins at the corner.
_HOLED = (
    _MESH[: _MESH.index("ring AS (")].replace("vertices AS (", "vertices0 AS (")
    + """joint AS (
  SELECT p.s, p.p, 13 * r + c + 2 AS v1, 13 * (r + 1) + c + 2 AS v2, q.x AS x1, q.y AS y1, t.x - q.x AS dx, t.y - q.y AS dy, p.p % 3 = 0 AS pinch
  FROM polygons p JOIN vertices0 q ON q.s = p.s AND q.v = 13 * r + c + 2 JOIN vertices0 t ON t.s = p.s AND t.v = 13 * (r + 1) + c + 2 WHERE p.p % 5 IN (0, 2)),
extra AS (
  SELECT s, p, 200 + 4 * p + k AS v, k, x1 + CASE k WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 ELSE 0.45 END * dx + CASE k WHEN 0 THEN 0.3 WHEN 1 THEN -0.2 WHEN 2 THEN -1.5 ELSE 1.25 END AS x,
    y1 + CASE k WHEN 0 THEN 0.3 WHEN 1 THEN 0.6 ELSE 0.45 END * dy AS y
  FROM joint, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE k > 0 OR NOT pinch),
vertices AS (SELECT s, v, x, y FROM vertices0 UNION ALL SELECT s, v, x, y FROM extra),
ring AS (
  SELECT s, p, row_number() OVER (PARTITION BY s, p ORDER BY i) - 1 AS i, v, count(*) OVER (PARTITION BY s, p) AS n FROM (
    SELECT s, p, i::DOUBLE AS i, 13 * (r + CASE WHEN i > 2 THEN 1 ELSE 0 END) + c + CASE i WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS v FROM polygons, (SELECT unnest(range(6)) AS i)
    UNION ALL SELECT s, p, 2 + CASE k WHEN 0 THEN 0.2 WHEN 2 THEN 0.4 ELSE 0.6 END, v FROM extra WHERE k <> 3
    UNION ALL SELECT s, p + 1, 5 + CASE k WHEN 1 THEN 0.2 WHEN 3 THEN 0.4 ELSE 0.6 END, v FROM extra WHERE k <> 2)),
"""
    + _MESH[_MESH.index("edge AS (") : _MESH.index("member AS (")].replace("(a.i + 1) % 6", "(a.i + 1) % a.n")
    + """gap0 AS (SELECT s, p, v1 AS v, x1 AS x, y1 AS y, 0 AS i FROM joint WHERE pinch UNION ALL SELECT s, p, v, x, y, CASE k WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END FROM extra),
gap AS (
  SELECT s, p, sum(part) / 2 AS h, sum(sx * part) / 6 AS hx, sum(sy * part) / 6 AS hy, sum(len) AS round FROM (
    SELECT a.s, a.p, a.x * b.y - b.x * a.y AS part, a.x + b.x AS sx, a.y + b.y AS sy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM gap0 a JOIN gap0 b ON a.s = b.s AND a.p = b.p AND b.i = (a.i + 1) % 4) GROUP BY s, p),
touch AS (
  SELECT e.s, e.p AS a, f.p AS b, e.v1, e.v2, e.x1, e.y1, e.x2, e.y2, sqrt((e.x2 - e.x1) ** 2 + (e.y2 - e.y1) ** 2) AS len FROM edge e JOIN edge f ON e.s = f.s AND e.lo = f.lo AND e.hi = f.hi AND e.p < f.p)
"""
)


def holed_mesh(spark: SparkSession, sf_dir: str) -> Network:
    """`mesh`, with a hole between the cells 5r and 5r + 1, and 5r + 2 and 5r + 3, of each row: two lines join them, or at every third one line and a corner."""
    net = mesh(spark, sf_dir)
    row, k = F.floor(F.col("polygon_id") / 5).cast("int"), (F.col("polygon_id") % 5).cast("int")
    corner = 13 * row + row % 2 + 2 * k + 2
    joints = net.polygons.where(k.isin(0, 2)).select("snapshot_id", F.col("polygon_id").alias("p"), corner.alias("v1"), (corner + 13).alias("v2"))
    end = lambda n: net.vertices.select("snapshot_id", F.col("vertex_id").cast("int").alias(f"v{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    joints = joints.join(end(1).hint("merge"), ["snapshot_id", "v1"]).join(end(2).hint("merge"), ["snapshot_id", "v2"])
    point = lambda n, part, aside: F.struct(F.lit(n).alias("n"), (F.col("x1") + part * (F.col("x2") - F.col("x1")) + aside).alias("x"), (F.col("y1") + part * (F.col("y2") - F.col("y1"))).alias("y"))
    new = joints.select("snapshot_id", "p", F.explode(F.array(point(0, 0.3, 0.3), point(1, 0.6, -0.2), point(2, 0.45, -1.5), point(3, 0.45, 1.25))).alias("e")).where("p % 3 <> 0 OR e.n > 0")
    new = new.select("snapshot_id", (200 + 4 * F.col("p") + F.col("e.n")).cast("long").alias("vertex_id"), "e.x", "e.y")
    added = lambda left, *order: F.filter(F.array(*[(200 + 4 * left + n).cast("int") for n in order]), lambda v: (left % 3 != 0) | (v % 4 != 0))
    own, other = added(F.col("polygon_id"), 0, 2, 1), added(F.col("polygon_id") - 1, 1, 3, 0)
    ids = F.when(k.isin(0, 2), F.concat(F.slice("vertex_ids", 1, 3), own, F.slice("vertex_ids", 4, 3))).when(k.isin(1, 3), F.concat("vertex_ids", other)).otherwise(F.col("vertex_ids"))
    return Network(net.vertices.withColumn("vertex_id", F.col("vertex_id").cast("long")).unionByName(new), net.lines, net.polygons.withColumn("vertex_ids", ids), net.labels)


def _pairs_and_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    net = holed_mesh(spark, sf_dir)
    return neighbours(net.polygons).select(*PAIR), cell_geometry(rings(net.vertices, net.polygons))


#: Of shared edges of equal length the first in the ring of the first cell counts.
@query(whole_sides(_HOLED + """, longest AS (
  SELECT t.s, t.a, t.b, sum(t.len) AS shared, arg_max({'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2, 'len': t.len}, (t.len, -e.i)) AS e FROM touch t JOIN edge e ON e.s = t.s AND e.p = t.a AND e.v1 = t.v1 AND e.v2 = t.v2 GROUP BY t.s, t.a, t.b),
point AS (SELECT DISTINCT q.s, q.a, q.b, e.v1 AS v, e.x1 AS x, e.y1 AS y FROM pairs q JOIN edge e ON e.s = q.s AND e.p IN (q.a, q.b)),
side AS (
  SELECT a.s, a.a, a.b, a.x * b.y - b.x * a.y AS part FROM point a JOIN point b ON a.s = b.s AND a.a = b.a AND a.b = b.b AND a.v <> b.v
  WHERE NOT EXISTS (SELECT 1 FROM point c WHERE c.s = a.s AND c.a = a.a AND c.b = a.b AND c.v NOT IN (a.v, b.v) AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0)),
hull AS (SELECT s, a, b, sum(part) / 2 AS hull FROM side GROUP BY ALL),
every AS (SELECT s, a, b, x, y FROM point UNION ALL SELECT s, p, p + 1, x1, y1 FROM joint WHERE pinch),
mom AS (SELECT s, a, b, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM every GROUP BY ALL),
u AS (
  SELECT l.s, l.a, l.b, l.e, l.shared, ca.area + cb.area + 2 * coalesce(h, 0) AS area, ca.per + cb.per - 2 * shared AS per, ca.area * ca.cx + cb.area * cb.cx + 2 * coalesce(hx, 0) AS mx, ca.area * ca.cy + cb.area * cb.cy + 2 * coalesce(hy, 0) AS my,
    greatest(ca.xm, cb.xm) - least(ca.x0, cb.x0) AS w, greatest(ca.ym, cb.ym) - least(ca.y0, cb.y0) AS h, (sqrt(ca.area) + sqrt(cb.area)) / 2 AS z
  FROM longest l JOIN cell ca ON ca.s = l.s AND ca.p = l.a JOIN cell cb ON cb.s = l.s AND cb.p = l.b LEFT JOIN gap g ON g.s = l.s AND g.p = l.a AND l.b = l.a + 1),
w AS (
  SELECT u.*, hull, abs((e.x2 - e.x1) * (e.y1 - my / area) - (e.y2 - e.y1) * (e.x1 - mx / area)) / e.len AS d, degrees(atan2(e.y2 - e.y1, e.x2 - e.x1)) - degrees(atan2(2 * sxy, sxx - syy) / 2) AS turn FROM u JOIN hull USING (s, a, b) JOIN mom USING (s, a, b)),
z AS (SELECT *, turn - 180 * floor(turn / 180) AS half FROM w)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(greatest(w, h) / least(w, h), 4) AS unionAspectRatio, round(4 * pi() * area / per ** 2, 4) AS unionCircularity, round((hull - area) / area, 4) AS unionConvexDeficiency,
 round(d, 4) AS sharedEdgeUnionCentroidDistance, round(d / z, 4) AS sharedEdgeUnionCentroidDistanceNormalized, round(CASE WHEN half <= 90 THEN half ELSE 180 - half END, 4) AS sharedEdgeUnionAxisAngleDegrees FROM z"""))
def holed_pair_union_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pair_features(*_pairs_and_cells(spark, sf_dir), ("union",))
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(_HOLED + """, outer_ring AS (
  SELECT g.s, g.p, ca.area + cb.area + h AS area, ca.per + cb.per - 2 * t.shared - round AS around FROM gap g JOIN cell ca ON ca.s = g.s AND ca.p = g.p JOIN cell cb ON cb.s = g.s AND cb.p = g.p + 1
  JOIN (SELECT s, a, b, sum(len) AS shared FROM touch GROUP BY ALL) t ON t.s = g.s AND t.a = g.p AND t.b = g.p + 1)
SELECT s AS snapshot_id, p AS first_id, p + 1 AS second_id, 1 AS ring, round(area, 4) AS area, round(around, 4) AS perimeter, false AS is_hole FROM outer_ring
UNION ALL SELECT s, p, p + 1, 2, round(h, 4), round(round, 4), true FROM gap""")
def holed_union_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_rings(*_pairs_and_cells(spark, sf_dir)).withColumns({c: _r(c) for c in ("area", "perimeter")})
