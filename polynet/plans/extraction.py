"""Registered queries of face extraction, pixel tables and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faces, pixels, places
from ..operators.cells import rings
from ..sources.mesh import mesh
from .catalogue import FEATURE, _features, _r, query

WIDTH, HEIGHT = 100, 60


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel tile of 10 by 10 for each customer, 60 tiles a snapshot: two lines, some broken, and a spur."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    side = F.sequence(F.lit(0), F.lit(9))
    c = c.withColumn("lx", F.explode(side)).withColumn("ly", F.explode(side))
    c = c.where("lx = 0 or (ly = 0 and not (n % 5 = 0 and lx > 4 and k % 2 = 1 and (k % 60) div 10 % 2 = 0)) or (lx = 5 and ly between 1 and n % 4)")
    return c.selectExpr("k div 60 as snapshot_id", "cast(10 * (k % 10) + lx as int) as x", "cast(10 * ((k % 60) div 10) + ly as int) as y")


_PIXELS = f"""
WITH RECURSIVE off AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE dx <> 0 OR dy <> 0),
px AS MATERIALIZED (
  SELECT c_custkey // 60 AS s, (10 * (c_custkey % 10) + lx)::INT AS x, (10 * (c_custkey % 60 // 10) + ly)::INT AS y FROM customer, (SELECT unnest(range(10)) AS lx), (SELECT unnest(range(10)) AS ly)
  WHERE lx = 0 OR (ly = 0 AND NOT (c_nationkey % 5 = 0 AND lx > 4 AND c_custkey % 2 = 1 AND c_custkey % 60 // 10 % 2 = 0)) OR (lx = 5 AND ly BETWEEN 1 AND c_nationkey % 4)),
nb AS MATERIALIZED (SELECT a.s, a.x, a.y, count(*) AS n FROM px a CROSS JOIN off JOIN px b ON b.s = a.s AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL),
jn AS MATERIALIZED (SELECT s, x, y, n, 1000 * y + x AS id FROM nb WHERE n >= 3 AND x BETWEEN 1 AND {WIDTH - 2} AND y BETWEEN 1 AND {HEIGHT - 2})"""
_CLUSTERS = """, jl AS MATERIALIZED (SELECT a.s, a.id AS u, b.id AS v FROM jn a JOIN jn b ON a.s = b.s AND a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4),
jr AS (SELECT s, id AS u, id AS v FROM jn UNION SELECT r.s, r.u, l.v FROM jr r JOIN jl l ON l.s = r.s AND l.u = r.v),
jc AS (SELECT s, u AS id, min(v) AS c FROM jr GROUP BY s, u),
jm AS (SELECT s, c, round_even(avg(x), 0)::INT AS vx, round_even(avg(y), 0)::INT AS vy FROM jc JOIN jn USING (s, id) GROUP BY s, c),
jv AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY vy, vx, c) - 1 AS vertex_id FROM jm),
cl AS MATERIALIZED (SELECT s, x, y, vertex_id, vx, vy FROM jc JOIN jn USING (s, id) JOIN jv USING (s, c))"""
_POINTS = """SELECT (c_custkey // 60)::BIGINT AS s, c_custkey AS point_id, c_acctbal::DOUBLE - 120 * floor(c_acctbal::DOUBLE / 120) AS x, 7 * c_acctbal::DOUBLE - 80 * floor(7 * c_acctbal::DOUBLE / 80) AS y FROM customer"""


def _pruned(rounds: int) -> str:
    steps = ["p0 AS MATERIALIZED (SELECT s, x, y FROM px)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT s, x, y FROM p{i} ANTI JOIN (SELECT s, x + dx AS x, y + dy AS y FROM p{i} CROSS JOIN off GROUP BY ALL HAVING count(*) = 1) USING (s, x, y))")
    return ", " + ", ".join(steps) + f" SELECT s AS snapshot_id, x, y FROM p{rounds}"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal").cast("double")
    wrapped = lambda v, n: v - n * F.floor(v / n)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("c_custkey div 60").cast("long").alias("snapshot_id"), F.col("c_custkey").alias("point_id"), wrapped(b, 120).alias("x"), wrapped(7 * b, 80).alias("y"))


@query(_PIXELS + " SELECT s AS snapshot_id, x, y, n AS neighbours FROM jn")
def pixel_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.junctions(skeleton(spark, sf_dir), WIDTH, HEIGHT)


@query(_PIXELS + _CLUSTERS + " SELECT s AS snapshot_id, x, y, vertex_id, vx, vy FROM cl")
def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.clusters(pixels.junctions(skeleton(spark, sf_dir), WIDTH, HEIGHT))


#: No tile's spur is longer than 24 pixels, so as many rounds as that prune them all.
@query(_PIXELS + _pruned(24))
def spur_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.without_spurs(skeleton(spark, sf_dir))


@query(_PIXELS + _CLUSTERS + """, free AS MATERIALIZED (SELECT s, x, y, 1000 * y + x AS id FROM px ANTI JOIN cl USING (s, x, y)),
fl AS MATERIALIZED (SELECT a.s, a.id AS u, b.id AS v FROM free a CROSS JOIN off JOIN free b ON b.s = a.s AND b.x = a.x + dx AND b.y = a.y + dy),
fr AS (SELECT s, id AS u, id AS v FROM free UNION SELECT r.s, r.u, l.v FROM fr r JOIN fl l ON l.s = r.s AND l.u = r.v),
path AS (SELECT s, u AS id, min(v) AS c FROM fr GROUP BY s, u),
touch AS MATERIALIZED (SELECT DISTINCT f.s, p.c, v.vertex_id AS k FROM free f JOIN path p ON p.s = f.s AND p.id = f.id CROSS JOIN off JOIN cl v ON v.s = f.s AND v.x = f.x + dx AND v.y = f.y + dy)
SELECT DISTINCT a.s AS snapshot_id, a.k AS v1, b.k AS v2 FROM touch a JOIN touch b ON a.s = b.s AND a.c = b.c AND a.k < b.k""")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    skeleton_pixels = skeleton(spark, sf_dir)
    return pixels.traced_lines(skeleton_pixels, pixels.clusters(pixels.junctions(skeleton_pixels, WIDTH, HEIGHT)))


@query("""WITH h AS (SELECT event_type, floor(value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT event_type, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER a AS n1, sum(n * v) OVER a AS s1 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY v), a AS (PARTITION BY event_type)),
d AS (SELECT *, n0::DOUBLE * (n1 - n0)::DOUBLE * (s0 / n0 - (s1 - s0) / nullif(n1 - n0, 0)) ** 2 AS score FROM c)
SELECT event_type, v::BIGINT AS threshold FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY coalesce(score, 0) DESC, v) = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.floor("value").alias("level")), ["event_type"], "level")


@query(""", h AS (SELECT s, mean AS v, count(*) AS n FROM junction WHERE mean IS NOT NULL GROUP BY ALL),
c AS (SELECT s, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER a AS n1, sum(n * v) OVER a AS s1 FROM h WINDOW w AS (PARTITION BY s ORDER BY v), a AS (PARTITION BY s)),
d AS (SELECT *, n0::DOUBLE * (n1 - n0)::DOUBLE * (s0 / n0 - (s1 - s0) / nullif(n1 - n0, 0)) ** 2 AS score FROM c)
SELECT s AS snapshot_id, round(v, 4) AS threshold FROM d QUALIFY row_number() OVER (PARTITION BY s ORDER BY coalesce(score, 0) DESC, v) = 1""")
def otsu_junction_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean junction angle that parts each snapshot's pairs best."""
    found = pixels.otsu(_features(mesh(spark, sf_dir), "junction"), ["snapshot_id"], FEATURE)
    return found.select("snapshot_id", _r("threshold").alias("threshold"))


@query(""", half AS (SELECT DISTINCT s, unnest([lo, hi]) AS o, unnest([hi, lo]) AS d FROM edge WHERE (lo + hi) % 7 <> 0),
ang AS (SELECT h.s, o, d, atan2(b.y - a.y, b.x - a.x) AS t FROM half h JOIN vertices a ON a.s = h.s AND a.v = o JOIN vertices b ON b.s = h.s AND b.v = d),
star AS (SELECT s, o, d, coalesce(lag(d) OVER w, last_value(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before
  FROM ang WINDOW w AS (PARTITION BY s, o ORDER BY CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END, d)),
nxt AS MATERIALIZED (SELECT s, d AS o, o AS d, o AS eo, before AS ed FROM star),
walk AS (
  SELECT s, o AS so, d AS sd, eo AS o, ed AS d, [o] AS ids FROM nxt
  UNION ALL SELECT w.s, so, sd, n.eo, n.ed, ids || [n.o] FROM walk w JOIN nxt n ON n.s = w.s AND n.o = w.o AND n.d = w.d WHERE w.o > so OR (w.o = so AND w.d > sd)),
face AS (SELECT s, list_sort(list_transform(range(1, len(ids) + 1), lambda i: ids[i:] || ids[:i - 1]))[1] AS ids FROM walk WHERE o = so AND d = sd AND len(ids) >= 3),
corner AS (SELECT f.s, f.ids, i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM face) f
  JOIN vertices a ON a.s = f.s AND a.v = f.ids[i] JOIN vertices b ON b.s = f.s AND b.v = f.ids[i % len(f.ids) + 1]),
shape AS (SELECT s, ids, sum(x1 * y2 - x2 * y1) / 2 AS area, min({'y': y1, 'x': x1}) AS top FROM corner GROUP BY s, ids)
SELECT s AS snapshot_id, row_number() OVER (PARTITION BY s ORDER BY top.y, top.x, ids) - 1 AS polygon_id, array_to_string(ids, ':') || ':' AS ring_key, len(ids) AS n_vertices, round(area, 4) AS area FROM shape WHERE area > 1e-6""")
def faces_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    found = faces.faces(net.vertices, net.lines.where("(v1 + v2) % 7 <> 0"))
    return found.select("snapshot_id", "polygon_id", faces.polygon_key(F.col("vertex_ids")).alias("ring_key"), F.size("vertex_ids").alias("n_vertices"), _r("area").alias("area"))


@query(""", ringed AS (SELECT r.s, p, list(r.v ORDER BY i) AS ids, min({'y': y, 'x': x}) AS top FROM ring r JOIN vertices v ON v.s = r.s AND v.v = r.v GROUP BY r.s, p)
SELECT s AS snapshot_id, array_to_string(ids, ':') AS ring, row_number() OVER (PARTITION BY s ORDER BY top.y, top.x, ids) - 1 AS polygon_id FROM ringed""")
def polygon_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    found = faces.ordered(faces.with_points(net.polygons.select("snapshot_id", "vertex_ids"), net.vertices))
    return found.select("snapshot_id", F.array_join("vertex_ids", ":").alias("ring"), F.col("polygon_id").cast("long").alias("polygon_id"))


@query(""", ringed AS (SELECT s, p, list(v ORDER BY i) AS ids FROM ring GROUP BY s, p),
every AS (SELECT s, p, ids FROM ringed UNION ALL SELECT s, p + 100, list_reverse(ids[3:] || ids[:2]) FROM ringed WHERE p % 3 = 0 UNION ALL SELECT s, p - 100, ids[2:] || ids[:1] FROM ringed WHERE p % 5 = 0),
k AS (SELECT s, p, list_sort(list_transform(range(1, 7), lambda i: ids[i:] || ids[:i - 1]) || list_transform(range(1, 7), lambda i: list_reverse(ids[i:] || ids[:i - 1])))[1] AS k FROM every)
SELECT s AS snapshot_id, min(p) AS polygon_id FROM k GROUP BY s, k""")
def polygon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mesh(spark, sf_dir).polygons
    turned = lambda n: F.concat(F.slice("vertex_ids", n + 1, 6), F.slice("vertex_ids", 1, n))
    copies = p.where("polygon_id % 3 = 0").select("snapshot_id", F.col("polygon_id") + 100, F.reverse(turned(2)))
    first = p.where("polygon_id % 5 = 0").select("snapshot_id", F.col("polygon_id") - 100, turned(1))
    return faces.distinct_polygons(p.union(copies).union(first)).select("snapshot_id", F.col("polygon_id").cast("long").alias("polygon_id"))


@query(f""", point AS ({_POINTS}), met AS (SELECT p.s, point_id, v, (v.x - p.x) ** 2 + (v.y - p.y) ** 2 AS d FROM point p JOIN vertices v ON v.s = p.s WHERE (v.x - p.x) ** 2 + (v.y - p.y) ** 2 <= 9)
SELECT s AS snapshot_id, point_id, v AS vertex_id, round(sqrt(d), 4) AS distance FROM met QUALIFY row_number() OVER (PARTITION BY s, point_id ORDER BY d, v) = 1""")
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places.nearest_vertex(_points(spark, sf_dir), mesh(spark, sf_dir).vertices, 3.0)
    return found.select("snapshot_id", "point_id", F.col("vertex_id").cast("long").alias("vertex_id"), _r("distance").alias("distance"))


@query(f""", point AS ({_POINTS})
SELECT p.s AS snapshot_id, point_id, e.p::BIGINT AS polygon_id FROM point p JOIN edge e ON e.s = p.s AND (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1""")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    found = places.holding_polygons(_points(spark, sf_dir), rings(net.vertices, net.polygons), 20.0)
    return found.select("snapshot_id", "point_id", F.col("polygon_id").cast("long").alias("polygon_id"))
