"""Registered queries of the polygon-network operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dealt
from ..operators import evaluate, matching, topology
from ..operators.adjacency import neighbours, relations, share_k_pairs
from ..operators.cells import cell_geometry, rings, single_cell_table, with_solidity
from ..operators.features import pair_features
from ..sources.mesh import Network, mesh
from ..sources.networks import repaired_labels

FEATURE, THRESHOLD = "junctionAngleAverageDegrees", 145.0
PAIR = ["snapshot_id", "first_id", "second_id"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _MESH + sql if sql.lstrip().startswith(",") else sql
        return f

    return add


def _r(c: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _cells(net: Network) -> DataFrame:
    return cell_geometry(rings(net.vertices, net.polygons))


def _features(net: Network, *families: str) -> DataFrame:
    cells = _cells(net)
    return pair_features(neighbours(net.polygons), with_solidity(cells) if "stats" in families else cells, families)


#: The mesh, its cells' edges and measures, its neighbouring pairs and labels.
_MESH = """
WITH RECURSIVE sizes AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM part) AS np),
snapshots AS (SELECT DISTINCT (c_custkey // 60)::BIGINT AS s FROM customer),
grid AS (SELECT s, v::BIGINT AS v FROM snapshots, (SELECT unnest(range(117)) AS v)),
vertices AS (
  SELECT s, v, 10 * (v % 13) + 4 * (c_acctbal::DOUBLE - floor(c_acctbal::DOUBLE)) - 2 AS x, 10 * (v // 13) + 4 * (p_retailprice::DOUBLE - floor(p_retailprice::DOUBLE)) - 2 AS y
  FROM grid CROSS JOIN sizes JOIN customer ON c_custkey = (131 * s + v) % nc JOIN part ON p_partkey = (97 * s + 7 * v) % np),
polygons AS (SELECT s, p::BIGINT AS p, p // 5 AS r, (p // 5) % 2 + 2 * (p % 5) AS c FROM snapshots, (SELECT unnest(range(40)) AS p)),
ring AS (
  SELECT s, p, i, 13 * (r + CASE WHEN i > 2 THEN 1 ELSE 0 END) + c + CASE i WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS v
  FROM polygons, (SELECT unnest(range(6)) AS i)),
edge AS (
  SELECT a.s, a.p, a.i, a.v AS v1, b.v AS v2, least(a.v, b.v) AS lo, greatest(a.v, b.v) AS hi, q.x AS x1, q.y AS y1, t.x AS x2, t.y AS y2
  FROM ring a JOIN ring b ON a.s = b.s AND a.p = b.p AND b.i = (a.i + 1) % 6
  JOIN vertices q ON q.s = a.s AND q.v = a.v JOIN vertices t ON t.s = b.s AND t.v = b.v),
cell0 AS (
  SELECT s, p, sum(x1 * y2 - x2 * y1) / 2 AS sa, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS per,
    sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my, min(x1) AS x0, max(x1) AS xm, min(y1) AS y0, max(y1) AS ym
  FROM edge GROUP BY s, p),
cell AS (
  SELECT s, p, abs(sa) AS area, per, mx / (6 * sa) AS cx, my / (6 * sa) AS cy, x0, xm, y0, ym,
    greatest(xm - x0, ym - y0) / least(xm - x0, ym - y0) AS aspect, 4 * pi() * abs(sa) / per ** 2 AS circ FROM cell0),
pairs AS (
  SELECT a.s, a.p AS a, b.p AS b FROM ring a JOIN ring b ON a.s = b.s AND a.v = b.v AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2),
labels AS (SELECT s, a, b, (a + b) % 36 + 1 AS t FROM pairs WHERE (7 * a + 3 * b + s) % 5 = 0),
member AS (SELECT s, a, b, v FROM pairs JOIN ring r USING (s) WHERE r.p = a INTERSECT SELECT s, a, b, v FROM pairs JOIN ring r USING (s) WHERE r.p = b),
away AS (
  SELECT m.s, m.a, m.b, m.v, side.p, CASE WHEN e.v1 = m.v THEN e.x2 - e.x1 ELSE e.x1 - e.x2 END AS dx, CASE WHEN e.v1 = m.v THEN e.y2 - e.y1 ELSE e.y1 - e.y2 END AS dy
  FROM member m, (SELECT unnest([0, 1]) AS which) w, LATERAL (SELECT CASE WHEN which = 0 THEN m.a ELSE m.b END AS p) side
  JOIN edge e ON e.s = m.s AND e.p = side.p AND (e.v1 = m.v OR e.v2 = m.v)
  WHERE NOT EXISTS (SELECT 1 FROM member n WHERE n.s = m.s AND n.a = m.a AND n.b = m.b AND n.v <> m.v AND n.v IN (e.v1, e.v2))),
angle AS (
  SELECT f.s, f.a, f.b, degrees(abs(atan2(f.dx * g.dy - f.dy * g.dx, f.dx * g.dx + f.dy * g.dy))) AS d
  FROM away f JOIN away g ON f.s = g.s AND f.a = g.a AND f.b = g.b AND f.v = g.v AND f.p = f.a AND g.p = g.b),
junction AS (SELECT s, a, b, avg(d) AS mean, max(d) AS hi, min(d) AS lo FROM angle GROUP BY s, a, b),
touch AS (SELECT e.s, e.p AS a, f.p AS b, e.v1, e.v2, e.x1, e.y1, e.x2, e.y2, sqrt((e.x2 - e.x1) ** 2 + (e.y2 - e.y1) ** 2) AS len
  FROM edge e JOIN edge f ON e.s = f.s AND e.lo = f.lo AND e.hi = f.hi AND e.p < f.p)
"""


@query("""SELECT a.k AS first_id, b.k AS second_id, count(*) AS n_shared
FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS m FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS k, l_partkey AS m FROM lineitem) b ON a.m = b.m AND a.k < b.k
GROUP BY ALL HAVING count(*) >= 2""")
def share_k_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_k_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), [], "l_orderkey", "l_partkey", 2)


@query(", touching AS (SELECT a.s, a.p AS a, b.p AS b, count(*) AS n FROM ring a JOIN ring b ON a.s = b.s AND a.v = b.v AND a.p < b.p GROUP BY ALL) SELECT s AS snapshot_id, a AS first_id, b AS second_id, n AS n_shared FROM touching")
def vertex_touch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(mesh(spark, sf_dir).polygons, 1)


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, p AS polygon_id, round(area, 4) AS area, round(per, 4) AS perimeter, round(cx, 4) AS cx, round(cy, 4) AS cy, round(aspect, 4) AS aspect_ratio, round(circ, 4) AS circularity, 6 AS vertex_count FROM cell")
def cell_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(mesh(spark, sf_dir)).select("snapshot_id", "polygon_id", *[_r(c).alias(c) for c in ("area", "perimeter", "cx", "cy", "aspect_ratio", "circularity")], "vertex_count")


def whole_sides(sql: str) -> str:
    """The SQL with whole sides of hulls where three points or more lie on one: a point on a side leaves it a side, one on its line beyond its ends doesn't.

    Points lie on steps of 0.0001 or more, so a cross product that is not 0 is far from 1e-9, and one that is 0 far below.
    """
    cross = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"
    assert sql.count(f"{cross} <= 0") == 1
    return sql.replace(f"{cross} <= 0", f"({cross} < -1e-9 OR ({cross} <= 1e-9 AND (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) > 0))")


_HULL = whole_sides(""", point AS (SELECT DISTINCT s, p, v1 AS v, x1 AS x, y1 AS y FROM edge),
side AS (
  SELECT a.s, a.p, a.x * b.y - b.x * a.y AS part FROM point a JOIN point b ON a.s = b.s AND a.p = b.p AND a.v <> b.v
  WHERE NOT EXISTS (SELECT 1 FROM point c WHERE c.s = a.s AND c.p = a.p AND c.v NOT IN (a.v, b.v) AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0)),
hull AS (SELECT s, p, sum(part) / 2 AS hull FROM side GROUP BY s, p)""")


@query(_HULL + """ SELECT c.s AS snapshot_id, c.p AS polygon_id, count(l.s) > 0 AS in_dividing_pair, round(any_value(area), 4) AS area, round(any_value(per), 4) AS perimeter,
 round(any_value(aspect), 4) AS aspect_ratio, round(any_value(circ), 4) AS circularity, round(any_value(area / hull), 4) AS solidity, 6 AS vertex_count
 FROM cell c JOIN hull h ON h.s = c.s AND h.p = c.p LEFT JOIN labels l ON l.s = c.s AND c.p IN (l.a, l.b) GROUP BY c.s, c.p""")
def single_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = single_cell_table(_cells(net), net.labels)
    return out.withColumns({c: _r(c) for c in ("area", "perimeter", "aspect_ratio", "circularity", "solidity")})


def _stats_sql() -> str:
    out = []
    for name, ratio, c in (("area", "areaRatio", "area"), ("perimeter", "perimeterRatio", "per"), ("aspect", "aspectRatio", "aspect"), ("circularity", "circularityRatio", "circ"), ("solidity", "solidityRatio", "sol")):
        a, b = f"a.{c}", f"b.{c}"
        out += [f"round(least({a}, {b}) / greatest({a}, {b}), 4) AS {ratio}", f"round(({a} + {b}) / 2, 4) AS {name}Mean", f"round(least({a}, {b}), 4) AS {name}Min", f"round(greatest({a}, {b}), 4) AS {name}Max", f"round(abs({a} - {b}), 4) AS {name}Diff"]
    out += ["1.0 AS vertexCountRatio", "6.0 AS vertexCountMean", "6.0 AS vertexCountMin", "6.0 AS vertexCountMax", "0.0 AS vertexCountDiff"]
    d = "sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)"
    return ", ".join([*out, f"round({d}, 4) AS centroidDistance", f"round({d} / ((sqrt(a.area) + sqrt(b.area)) / 2), 4) AS centroidDistanceNormalized"])


@query(_HULL + ", full_cell AS (SELECT cell.*, area / hull AS sol FROM cell JOIN hull USING (s, p)) SELECT q.s AS snapshot_id, q.a AS first_id, q.b AS second_id, " + _stats_sql() + " FROM pairs q JOIN full_cell a ON a.s = q.s AND a.p = q.a JOIN full_cell b ON b.s = q.s AND b.p = q.b")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(mesh(spark, sf_dir), "stats")
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


def _segment(px: str, py: str) -> str:
    t = f"greatest(0, least(1, (({px} - t.x1) * (t.x2 - t.x1) + ({py} - t.y1) * (t.y2 - t.y1)) / ((t.x2 - t.x1) ** 2 + (t.y2 - t.y1) ** 2)))"
    return f"sqrt((t.x1 + {t} * (t.x2 - t.x1) - {px}) ** 2 + (t.y1 + {t} * (t.y2 - t.y1) - {py}) ** 2)"


@query(f""", off AS (SELECT t.s, t.a, t.b, avg({_segment("e.x1", "e.y1")}) AS d FROM touch t JOIN edge e ON e.s = t.s AND e.p IN (t.a, t.b) AND e.v1 NOT IN (t.v1, t.v2) GROUP BY t.s, t.a, t.b),
m AS (SELECT t.*, o.d, ({_segment("a.cx", "a.cy")} + {_segment("b.cx", "b.cy")}) / 2 AS c, (sqrt(a.area) + sqrt(b.area)) / 2 AS z
  FROM touch t JOIN off o ON o.s = t.s AND o.a = t.a AND o.b = t.b JOIN cell a ON a.s = t.s AND a.p = t.a JOIN cell b ON b.s = t.s AND b.p = t.b)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(len, 4) AS sharedEdgeLength, round(len / z, 4) AS normalizedSharedEdgeLength, round(d, 4) AS sharedEdgeUnsharedVerticesDistance,
 round(d / z, 4) AS sharedEdgeUnsharedVerticesDistanceNormalized, round(c, 4) AS centroidSharedEdgeDistance, round(c / z, 4) AS centroidSharedEdgeDistanceNormalized FROM m""")
def pair_shared_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(mesh(spark, sf_dir), "shared_edge")
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(""", point AS (SELECT DISTINCT t.s, t.a, t.b, e.v1 AS v, e.x1 AS x, e.y1 AS y FROM touch t JOIN edge e ON e.s = t.s AND e.p IN (t.a, t.b)),
side AS (
  SELECT a.s, a.a, a.b, a.x * b.y - b.x * a.y AS part FROM point a JOIN point b ON a.s = b.s AND a.a = b.a AND a.b = b.b AND a.v <> b.v
  WHERE NOT EXISTS (SELECT 1 FROM point c WHERE c.s = a.s AND c.a = a.a AND c.b = a.b AND c.v NOT IN (a.v, b.v) AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0)),
hull AS (SELECT s, a, b, sum(part) / 2 AS hull FROM side GROUP BY ALL),
mom AS (SELECT s, a, b, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM point GROUP BY ALL),
u AS (SELECT t.*, ca.area + cb.area AS area, ca.per + cb.per - 2 * t.len AS per, (ca.area * ca.cx + cb.area * cb.cx) / (ca.area + cb.area) AS cx, (ca.area * ca.cy + cb.area * cb.cy) / (ca.area + cb.area) AS cy,
  greatest(ca.xm, cb.xm) - least(ca.x0, cb.x0) AS w, greatest(ca.ym, cb.ym) - least(ca.y0, cb.y0) AS h, (sqrt(ca.area) + sqrt(cb.area)) / 2 AS z
  FROM touch t JOIN cell ca ON ca.s = t.s AND ca.p = t.a JOIN cell cb ON cb.s = t.s AND cb.p = t.b),
w AS (SELECT u.*, hull, abs((x2 - x1) * (y1 - cy) - (y2 - y1) * (x1 - cx)) / len AS d, degrees(atan2(y2 - y1, x2 - x1)) - degrees(atan2(2 * sxy, sxx - syy) / 2) AS turn
  FROM u JOIN hull USING (s, a, b) JOIN mom USING (s, a, b)),
z AS (SELECT *, turn - 180 * floor(turn / 180) AS half FROM w)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(greatest(w, h) / least(w, h), 4) AS unionAspectRatio, round(4 * pi() * area / per ** 2, 4) AS unionCircularity, round((hull - area) / area, 4) AS unionConvexDeficiency,
 round(d, 4) AS sharedEdgeUnionCentroidDistance, round(d / z, 4) AS sharedEdgeUnionCentroidDistanceNormalized, round(CASE WHEN half <= 90 THEN half ELSE 180 - half END, 4) AS sharedEdgeUnionAxisAngleDegrees FROM z""")
def pair_union_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(mesh(spark, sf_dir), "union")
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(mean, 4) AS junctionAngleAverageDegrees, round(hi, 4) AS junctionAngleMaxDegrees, round(lo, 4) AS junctionAngleMinDegrees, round(hi - lo, 4) AS junctionAngleDifferenceDegrees, round(lo / hi, 4) AS junctionAngleRatio FROM junction")
def junction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(mesh(spark, sf_dir), "junction")
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, a AS first_id, b AS second_id, count(*) AS n_shared, min(v)::BIGINT AS first_shared, max(v)::BIGINT AS last_shared FROM member GROUP BY s, a, b")
def pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = relations(neighbours(net.polygons).drop("n_shared"), _cells(net))
    return out.select(*PAIR, F.size("shared_vertices").cast("long").alias("n_shared"), F.array_min("shared_vertices").cast("long").alias("first_shared"), F.array_max("shared_vertices").cast("long").alias("last_shared"))


def _candidates(net: Network) -> DataFrame:
    return matching.candidates(_features(net, "junction"), FEATURE, THRESHOLD)


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(mean, 4) AS value, round(mean - 145, 4) AS score FROM junction WHERE mean >= 145")
def estimate_unconstrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match(_candidates(mesh(spark, sf_dir)), matching.UNCONSTRAINED)
    return out.select(*PAIR, _r("value").alias("value"), _r("score").alias("score"))


@query(""", ranked AS (SELECT s, a, b, row_number() OVER (PARTITION BY s ORDER BY mean DESC, a, b) AS k FROM junction WHERE mean >= 145),
taken AS (
  SELECT s, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM snapshots
  UNION ALL
  SELECT t.s, t.k + 1, CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN used ELSE used || [r.a, r.b] END,
    CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN NULL ELSE r.a END, r.b
  FROM taken t JOIN ranked r ON r.s = t.s AND r.k = t.k + 1)
SELECT s AS snapshot_id, a AS first_id, b AS second_id FROM taken WHERE a IS NOT NULL""")
def estimate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(_candidates(mesh(spark, sf_dir)), matching.GREEDY).select(*PAIR)


#: Every matching of each connected component, pair by pair; components of the walls are short rows of cells, so there are few.
@query(""", cand AS MATERIALIZED (SELECT s, a, b, mean - 145 AS score FROM junction WHERE mean > 145),
linked AS MATERIALIZED (SELECT s, a AS u, b AS v FROM cand UNION SELECT s, b, a FROM cand),
reach AS (SELECT DISTINCT s, u, u AS v FROM linked UNION SELECT r.s, r.u, l.v FROM reach r JOIN linked l ON l.s = r.s AND l.u = r.v),
part AS MATERIALIZED (SELECT s, u, min(v) AS c FROM reach GROUP BY s, u),
placed AS MATERIALIZED (SELECT cand.*, c, row_number() OVER (PARTITION BY cand.s, c ORDER BY a, b) AS k FROM cand JOIN part ON part.s = cand.s AND part.u = a),
tried AS (
  SELECT DISTINCT s, c, 0::BIGINT AS k, []::BIGINT[] AS used, 0::DOUBLE AS total FROM placed
  UNION ALL
  SELECT t.s, t.c, t.k + 1, CASE WHEN take THEN used || [p.a::BIGINT, p.b::BIGINT] ELSE used END, CASE WHEN take THEN total + p.score ELSE total END
  FROM tried t JOIN placed p ON p.s = t.s AND p.c = t.c AND p.k = t.k + 1 CROSS JOIN (SELECT unnest([true, false]) AS take)
  WHERE NOT take OR NOT (list_contains(used, p.a) OR list_contains(used, p.b))),
best AS (SELECT s, c, arg_max(used, (k, total)) AS used FROM tried GROUP BY s, c)
SELECT s AS snapshot_id, used[2 * i + 1] AS first_id, used[2 * i + 2] AS second_id FROM (SELECT s, used, unnest(range(len(used) // 2)) AS i FROM best)""")
def estimate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(_candidates(mesh(spark, sf_dir)), matching.GLOBAL).select(*PAIR)


_COUNTS = """SELECT {key} count(*) FILTER (est) AS estimated_pairs, count(*) FILTER (lab) AS real_pairs, count(*) AS neighbor_pairs,
 count(*) FILTER (est AND lab) AS true_positive, count(*) FILTER (est AND NOT lab) AS false_positive, count(*) FILTER (NOT est AND lab) AS false_negative, count(*) FILTER (NOT est AND NOT lab) AS true_negative FROM flags GROUP BY ALL"""
_RATIOS = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE -1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE -1 END, 6) AS recall,
 round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE -1 END, 6) AS specificity, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE -1 END, 6) AS f1"""
_FLAGS = ", flags AS (SELECT j.s, j.a, j.b, mean >= 145 AS est, l.s IS NOT NULL AS lab FROM junction j LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b) "


def _flags(net: Network) -> DataFrame:
    return evaluate.flagged(evaluate.universe(net.polygons, net.pairs), _candidates(net), net.labels)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _r(c, 6) for c in ("precision", "recall", "specificity", "accuracy", "f1")})


@query(_FLAGS + _COUNTS.format(key="s AS snapshot_id,"))
def confusion_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counts(_flags(mesh(spark, sf_dir)), ["snapshot_id"])


@query(_FLAGS + ", n AS (" + _COUNTS.format(key="") + "), m AS (SELECT *, true_positive::DOUBLE AS tp, false_positive AS fp, false_negative AS fn, true_negative AS tn FROM n) SELECT * EXCLUDE (tp, fp, fn, tn), " + _RATIOS + " FROM m")
def metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.totals(evaluate.counts(_flags(mesh(spark, sf_dir)), ["snapshot_id"]), []))


@query(_FLAGS + "SELECT f.s AS snapshot_id, f.a AS first_id, f.b AS second_id, CASE WHEN est AND lab THEN 'TP' WHEN est THEN 'FP' WHEN lab THEN 'FN' ELSE 'TN' END AS category, coalesce(t, -1)::INT AS division_time FROM flags f LEFT JOIN labels l ON l.s = f.s AND l.a = f.a AND l.b = f.b")
def pair_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = _flags(net).join(net.labels.hint("merge"), PAIR, "left")
    return out.select(*PAIR, evaluate.category(F.col("est"), F.col("real")).alias("category"), F.coalesce("division_time", F.lit(-1)).alias("division_time"))


@query(", flags AS (SELECT th AS threshold, mean >= th AS est, l.s IS NOT NULL AS lab FROM junction j CROSS JOIN (SELECT 90.0 + 5 * unnest(range(19)) AS th) LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b), n AS (" + _COUNTS.format(key="threshold::DOUBLE AS threshold,") + "), m AS (SELECT *, true_positive::DOUBLE AS tp, false_positive AS fp, false_negative AS fn, true_negative AS tn FROM n) SELECT * EXCLUDE (tp, fp, fn, tn), " + _RATIOS + " FROM m")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return _rounded(evaluate.sweep(_features(net, "junction"), net.labels, FEATURE, [90.0 + 5 * i for i in range(19)]))


@query(", x AS (SELECT 1) SELECT j.s AS snapshot_id, j.a AS first_id, j.b AS second_id, (l.s IS NOT NULL)::INT AS observed, (mean >= 145)::INT - (hi >= 160)::INT AS estimated_division_difference, round(mean - hi, 4) AS feature_difference FROM junction j LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b WHERE (mean >= 145) <> (hi >= 160)")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    real = net.labels.select(*PAIR, F.lit(1).alias("observed"))
    rows = dealt(_features(net, "junction"), *PAIR).join(real.hint("merge"), PAIR, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    result = lambda feature, t: rows.select(*PAIR, "observed", (F.col(feature) >= t).cast("int").alias("estimated"), F.col(feature).alias("value"))
    out = evaluate.compare(result(FEATURE, THRESHOLD), result("junctionAngleMaxDegrees", 160.0))
    return out.withColumn("feature_difference", _r("feature_difference"))


@query(", x AS (SELECT DISTINCT e.s, e.lo, e.hi FROM edge e), y AS (SELECT x.*, b.x - a.x AS dx, b.y - a.y AS dy, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my FROM x JOIN vertices a ON a.s = x.s AND a.v = lo JOIN vertices b ON b.s = x.s AND b.v = hi), z AS (SELECT *, degrees(atan2(dy, dx)) - 180 * floor(degrees(atan2(dy, dx)) / 180) AS g FROM y) SELECT s AS snapshot_id, lo AS v1, hi AS v2, round(sqrt(dx ** 2 + dy ** 2), 4) AS length, round(mx, 4) + 0.0 AS mid_x, round(my, 4) + 0.0 AS mid_y, round(g, 4) AS angle, round(CASE WHEN g <= 90 THEN g ELSE 180 - g END, 4) AS acute_angle FROM z")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = topology.line_geometry(net.vertices, net.lines)
    return out.select("snapshot_id", "v1", "v2", *[(_r(c) + 0.0).alias(c) for c in ("length", "mid_x", "mid_y", "angle", "acute_angle")])


@query(", x AS (SELECT l.s, a, b, t FROM labels l) SELECT s AS snapshot_id, a AS first_id, b AS second_id, t::INT AS division_time FROM x")
def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    shifted = net.labels.withColumns({"first_id": F.col("first_id") + 1, "second_id": F.col("second_id") + 1})
    last = shifted.groupBy("snapshot_id").agg(F.max("second_id").alias("m")).where("m >= 40").select("snapshot_id")
    whole = shifted.join(last.hint("merge"), "snapshot_id", "left_semi").union(net.labels.join(last.hint("merge"), "snapshot_id", "left_anti"))
    return repaired_labels(whole, net.polygons)


@query(""", deg AS (SELECT s, v, count(*) AS d FROM (SELECT DISTINCT s, lo, hi, unnest([lo, hi]) AS v FROM edge WHERE (lo + hi) % 7 <> 0) GROUP BY ALL)
SELECT g.s AS snapshot_id, g.v AS vertex_id, coalesce(d, 0)::BIGINT AS degree, EXISTS (SELECT 1 FROM ring r WHERE r.s = g.s AND r.v = g.v) AS in_polygon FROM vertices g LEFT JOIN deg ON deg.s = g.s AND deg.v = g.v
WHERE coalesce(d, 0) <= 1 OR NOT EXISTS (SELECT 1 FROM ring r WHERE r.s = g.s AND r.v = g.v)""")
def topology_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return topology.suspect_vertices(net.vertices, net.lines.where("(v1 + v2) % 7 <> 0"), net.polygons)


@query(", x AS (SELECT 1) SELECT DISTINCT s AS snapshot_id, lo AS v1, hi AS v2 FROM edge WHERE (lo + hi) % 7 = 0")
def missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return topology.missing_lines(net.lines.where("(v1 + v2) % 7 <> 0"), net.polygons)


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, p AS polygon_id FROM polygons q WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.s = q.s AND r.p = q.p AND r.v % 11 = 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    _, left = topology.without_vertices(net.lines, net.polygons, net.vertices.where("vertex_id % 11 = 0"))
    return left.select("snapshot_id", "polygon_id")
