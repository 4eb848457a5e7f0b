"""Registered queries of lookups, polygon orders, restricted comparisons, and what readers and rule lists leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate, faces, places, rules, topology
from ..operators.adjacency import neighbours, relations
from ..operators.cells import cell_geometry, rings
from ..sources.mesh import mesh
from ..sources.networks import networks_of, plain_label_lines
from ..sources.sinks import rule_metrics_table
from .catalogue import FEATURE, PAIR, _candidates, _cells, _features, _r, query

MOST = "junctionAngleMaxDegrees"


def _near_by(polygons: DataFrame, step: int, every: int) -> DataFrame:
    """Pairs of cells `step` apart in number, most of which are no neighbours."""
    first, second = F.col("polygon_id"), F.col("polygon_id") + step
    return polygons.where((first % every == 0) & (second < 40)).select("snapshot_id", first.alias("first_id"), second.alias("second_id"))


@query(""", est AS (SELECT s, a, b FROM junction WHERE mean >= 145 UNION SELECT s, p, p + 2 FROM polygons WHERE p % 7 = 0 AND p + 2 < 40),
lab AS (SELECT s, a, b FROM labels UNION SELECT s, p, p + 3 FROM polygons WHERE p % 9 = 0 AND p + 3 < 40),
every AS (SELECT s, a, b FROM pairs UNION SELECT * FROM est UNION SELECT * FROM lab),
flags AS (SELECT v.s, n.s IS NOT NULL AS near, e.s IS NOT NULL AS est, l.s IS NOT NULL AS lab FROM every v LEFT JOIN pairs n ON n.s = v.s AND n.a = v.a AND n.b = v.b
  LEFT JOIN est e ON e.s = v.s AND e.a = v.a AND e.b = v.b LEFT JOIN lab l ON l.s = v.s AND l.a = v.a AND l.b = v.b)
SELECT s AS snapshot_id, count(*) FILTER (near AND est) AS estimated_pairs, count(*) FILTER (near AND lab) AS real_pairs, count(*) FILTER (near) AS neighbor_pairs,
 count(*) FILTER (near AND est AND lab) AS true_positive, count(*) FILTER (near AND est AND NOT lab) AS false_positive, count(*) FILTER (near AND NOT est AND lab) AS false_negative,
 count(*) FILTER (near AND NOT est AND NOT lab) AS true_negative, count(*) FILTER (est AND NOT near) AS dropped_estimated, count(*) FILTER (lab AND NOT near) AS dropped_real FROM flags GROUP BY s""")
def compare_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    est = _candidates(net).select(*PAIR).union(_near_by(net.polygons, 2, 7))
    real = net.labels.select(*PAIR).union(_near_by(net.polygons, 3, 9))
    return evaluate.restricted_counts(evaluate.flagged(neighbours(net.polygons), est, real), ["snapshot_id"])


@query(""", x AS (SELECT j.*, l.s IS NOT NULL AS lab, mean >= 145 AS e1, hi >= 160 AS e2 FROM junction j LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, lab::INT AS observed, e1::INT - e2::INT AS estimated_division_difference, round(mean - 5 * floor(mean / 5), 4) AS mean_difference, round(hi - 5 * floor(hi / 5), 4) AS most_difference FROM x WHERE e1 <> e2""")
def compare_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    real = net.labels.select(*PAIR, F.lit(1).alias("observed"))
    rows = _features(net, "junction").join(real.hint("merge"), PAIR, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    coarse = lambda c: (5 * F.floor(F.col(c) / 5)).cast("double")
    first = rows.select(*PAIR, "observed", (F.col(FEATURE) >= 145).cast("int").alias("estimated"), F.col(FEATURE).alias("mean"), F.col(MOST).alias("most"))
    second = rows.select(*PAIR, "observed", (F.col(MOST) >= 160).cast("int").alias("estimated"), coarse(MOST).alias("most"), coarse(FEATURE).alias("mean"), "junctionAngleMinDegrees")
    out = evaluate.compare_all(first, second)
    return out.withColumns({c: _r(c) for c in ("mean_difference", "most_difference")})


@query(""", ringed AS (SELECT s, p, list(v ORDER BY i) AS ids FROM ring GROUP BY s, p)
SELECT s AS snapshot_id, array_to_string(list_reverse(ids), ' ;') AS text, p::INT AS polygon_id FROM ringed WHERE p % 3 = 0
UNION ALL SELECT s, array_to_string(list_transform(ids, lambda v: v + 26), ', '), p::INT + 10 FROM ringed WHERE p % 3 = 2 AND p < 30""")
def polygons_by_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = mesh(spark, sf_dir).polygons
    ids, kind = F.col("vertex_ids"), F.col("polygon_id") % 3
    repeated = F.concat(F.array_join(ids, ","), F.lit(","), F.get(ids, 0).cast("string"))  # an id twice: no list
    text = F.when(kind == 0, F.array_join(F.reverse(ids), " ;")).when(kind == 1, repeated).otherwise(F.array_join(F.transform(ids, lambda v: v + 26), ", "))
    wanted = polygons.select("snapshot_id", text.alias("text")).withColumn("vertex_ids", faces.id_list(F.col("text")))
    return faces.polygons_of_vertices(polygons, wanted.where("vertex_ids is not null")).select("snapshot_id", "text", "polygon_id")


@query(", x AS (SELECT 1) SELECT DISTINCT s AS snapshot_id, hi AS v1, lo AS v2, lo * 1000 + hi AS line_id FROM edge WHERE hi = lo + 1")
def lines_by_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    wanted = net.vertices.select("snapshot_id", (F.col("vertex_id") + 1).alias("v1"), F.col("vertex_id").alias("v2"))
    return faces.lines_between(net.lines, wanted)


@query(""", point AS (SELECT s, x, y FROM vertices UNION ALL SELECT s, x + 0.0002, y - 0.0002 FROM vertices WHERE v % 3 = 0 UNION ALL SELECT s, x + 0.002, y FROM vertices WHERE v % 5 = 0),
snapped AS (SELECT s, sign(x) * floor(abs(x) * 1000 + 0.5) / 1000 + 0.0 AS x, sign(y) * floor(abs(y) * 1000 + 0.5) / 1000 + 0.0 AS y, count(*) AS n_points FROM point GROUP BY ALL)
SELECT s AS snapshot_id, (row_number() OVER (PARTITION BY s ORDER BY y, x) - 1)::INT AS vertex_id, x, y, n_points FROM snapped""")
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = mesh(spark, sf_dir).vertices
    x, y = F.col("x"), F.col("y")
    close = at.where("vertex_id % 3 = 0").select("snapshot_id", "vertex_id", x + 0.0002, y - 0.0002)
    apart = at.where("vertex_id % 5 = 0").select("snapshot_id", "vertex_id", x + 0.002, y)
    found = faces.snapped_vertices(at.union(close).union(apart))
    return found.groupBy("snapshot_id", "vertex_id", "x", "y").agg(F.count("*").alias("n_points"))


@query(""", ringed AS (SELECT r.s, p, list(r.v ORDER BY i) AS ids, list({'y': y, 'x': x} ORDER BY y, x) AS points FROM ring r JOIN vertices v ON v.s = r.s AND v.v = r.v GROUP BY r.s, p)
SELECT s AS snapshot_id, array_to_string(ids, ':') AS ring, row_number() OVER (PARTITION BY s ORDER BY points, ids) - 1 AS polygon_id FROM ringed""")
def polygon_order_by_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    found = faces.ordered_by_points(faces.with_points(net.polygons.select("snapshot_id", "vertex_ids"), net.vertices))
    return found.select("snapshot_id", F.array_join("vertex_ids", ":").alias("ring"), F.col("polygon_id").cast("long").alias("polygon_id"))


@query(", x AS (SELECT s, CASE s % 5 WHEN 1 THEN 'no_polygons' WHEN 2 THEN 'fewer_than_two_polygons' WHEN 3 THEN 'no_labels' ELSE CASE WHEN s NOT IN (SELECT s FROM labels) THEN 'no_labels' END END AS code FROM snapshots) SELECT s AS snapshot_id, code FROM x WHERE code IS NOT NULL")
def snapshots_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    kind = F.col("snapshot_id") % 5
    polygons = net.polygons.where((kind != 1) & ((kind != 2) | (F.col("polygon_id") == 0)))
    return evaluate.skipped(net.vertices, polygons, net.labels.where(kind != 3))


@query(""", line AS (SELECT DISTINCT s, lo, hi FROM edge), whole AS (SELECT s FROM snapshots WHERE s % 6 <> 5)
SELECT s AS snapshot_id, 'error' AS severity, 'no_vertices' AS code, NULL::VARCHAR AS detail FROM snapshots WHERE s % 6 = 5
UNION ALL SELECT s, 'warning', 'vertex_repeated', v::VARCHAR FROM vertices JOIN whole USING (s) WHERE v % 10 = 0
UNION ALL SELECT s, 'warning', 'line_without_vertex', (lo * 1000 + hi)::VARCHAR FROM line JOIN whole USING (s) WHERE lo % 20 = 0
UNION ALL SELECT s, 'warning', 'polygon_too_small', p::VARCHAR FROM polygons JOIN whole USING (s) WHERE p % 13 = 5
UNION ALL SELECT s, 'warning', 'polygon_without_vertex', p::VARCHAR FROM polygons JOIN whole USING (s) WHERE p % 13 = 7
UNION ALL SELECT s, 'warning', 'pair_without_polygon', a || ' ' || b FROM pairs JOIN whole USING (s) WHERE a % 13 IN (5, 7) OR b % 13 IN (5, 7)""")
def network_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader leaves out of documents in which vertices repeat and others lack."""
    net = mesh(spark, sf_dir)
    listed = lambda df, name, *fields: df.groupBy("snapshot_id").agg(F.collect_list(F.struct(*fields)).alias(name))
    point = [F.col("vertex_id").alias("id"), "x", "y"]
    end = F.when(F.col("v1") % 20 == 0, 999).otherwise(F.col("v2")).alias("endVertexId")
    kind = F.col("polygon_id") % 13
    ring = F.when(kind == 5, F.slice("vertex_ids", 1, 2)).when(kind == 7, F.concat("vertex_ids", F.array(F.lit(999)))).otherwise(F.col("vertex_ids"))
    docs = listed(net.vertices, "once", *point)
    for table in (
        listed(net.vertices.where("vertex_id % 10 = 0").withColumn("x", F.col("x") + 1), "again", *point),
        listed(net.lines, "lines", F.col("line_id").alias("id"), F.col("v1").alias("startVertexId"), end),
        listed(net.polygons, "polygons", F.col("polygon_id").alias("id"), ring.alias("vertexIds")),
        listed(neighbours(net.polygons), "neighborPairs", F.col("second_id").alias("firstPolygonId"), F.col("first_id").alias("secondPolygonId")),
    ):
        docs = docs.join(table.hint("merge"), "snapshot_id")
    vertices = F.when(F.col("snapshot_id") % 6 != 5, F.concat("once", "again"))
    return networks_of(docs.select("snapshot_id", vertices.alias("vertices"), "lines", "polygons", "neighborPairs"))[1]


@query(""", said AS (SELECT * FROM (VALUES (0, 'junction angle mean', ''), (1, 'no such feature', 'unknown feature no such feature'), (2, 'junction angle max', 'invalid cutoff for junction angle max'), (3, 'junctionAngleMaxDegrees', '')) r(line, feature, errors)),
flags AS (SELECT line, j.s, CASE line WHEN 0 THEN mean >= 145 ELSE hi >= 160 END AS est, l.s IS NOT NULL AS lab FROM junction j CROSS JOIN said LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b WHERE errors = '' AND j.s % 5 <> 3 AND j.s IN (SELECT s FROM labels)),
n AS (SELECT line, count(DISTINCT s) AS files_processed, count(*) FILTER (est) AS estimated_pairs, count(*) FILTER (lab) AS real_pairs, count(*) FILTER (est AND lab) AS true_positive, count(*) FILTER (NOT est AND lab) AS false_negative FROM flags GROUP BY line),
lost AS (SELECT count(*) AS k FROM snapshots WHERE s % 5 = 3 OR s NOT IN (SELECT s FROM labels))
SELECT line, feature, errors, coalesce(files_processed, 0) AS files_processed, coalesce(estimated_pairs, 0) AS estimated_pairs, coalesce(real_pairs, 0) AS real_pairs, coalesce(true_positive, 0) AS true_positive, coalesce(false_negative, 0) AS false_negative, CASE WHEN k > 0 THEN k || ' snapshots left out: no_labels' ELSE '' END AS warnings FROM said LEFT JOIN n USING (line) CROSS JOIN lost""")
def rule_list_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule list with an unknown feature and a bad cutoff, on snapshots some of which have no labels."""
    net = mesh(spark, sf_dir)
    lines = [("junction angle mean", 145.0, True, None), ("no such feature", 1.0, True, None), ("junction angle max", None, True, None), (MOST, 160.0, True, None)]
    table = spark.createDataFrame(lines, "feature string, threshold double, require_above boolean, note string")
    labels = net.labels.where("snapshot_id % 5 <> 3")
    good, _ = rules.rules_of(table)
    metrics = rules.rule_metrics(_features(net, "junction"), neighbours(net.polygons), labels, good)
    report = rules.rule_report(metrics, table, evaluate.skipped(net.vertices, net.polygons, labels))
    return report.select("line", "feature", "errors", "files_processed", "estimated_pairs", "real_pairs", "true_positive", "false_negative", "warnings")


@query(""", said AS (SELECT * FROM (VALUES (0, 'Junction Angle Average (deg)', 'junctionAngleAverageDegrees', '145.000000', '>= cutoff', 'large angles', ''), (1, 'no such feature', '', '1.000000', '<= cutoff', '', 'unknown feature no such feature'),
  (2, 'Junction Angle Max (deg)', 'junctionAngleMaxDegrees', '', '>= cutoff', '', 'invalid cutoff for junction angle max'), (3, 'Junction Angle Min (deg)', 'junctionAngleMinDegrees', '100.000000', '<= cutoff', '', '')) r(line, feature, feature_key, threshold, comparison, note, errors)),
flags AS (SELECT line, j.s, CASE line WHEN 0 THEN mean >= 145 ELSE lo <= 100 END AS est, l.s IS NOT NULL AS lab FROM junction j CROSS JOIN said LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b WHERE errors = '' AND j.s IN (SELECT s FROM labels)),
n AS (SELECT line, count(DISTINCT s) AS files, count(DISTINCT s) FILTER (est) AS hits, count(*) FILTER (est) AS est, count(*) FILTER (lab) AS lab, count(*) FILTER (est AND lab) AS tp, count(*) FILTER (est AND NOT lab) AS fp, count(*) FILTER (NOT est AND lab) AS fn, count(*) FILTER (NOT est AND NOT lab) AS tn FROM flags GROUP BY line),
m AS (SELECT said.*, coalesce(files, 0) AS files, coalesce(hits, 0) AS hits, coalesce(est, 0) AS est, coalesce(lab, 0) AS lab, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM said LEFT JOIN n USING (line))
SELECT feature, feature_key, threshold, comparison, files AS files_processed, hits AS files_with_results, est AS estimated_pairs, lab AS real_pairs, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative,
 CASE WHEN tp + fp > 0 THEN printf('%.6f', tp::DOUBLE / (tp + fp)) ELSE 'N/A' END AS precision, CASE WHEN tp + fn > 0 THEN printf('%.6f', tp::DOUBLE / (tp + fn)) ELSE 'N/A' END AS recall, CASE WHEN tp > 0 THEN printf('%.6f', 2 * tp::DOUBLE / (2 * tp + fp + fn)) ELSE 'N/A' END AS f1,
 CASE WHEN tn + fp > 0 THEN printf('%.6f', tn::DOUBLE / (tn + fp)) ELSE 'N/A' END AS specificity, CASE WHEN tp + fp + fn + tn > 0 THEN printf('%.6f', (tp + tn)::DOUBLE / (tp + fp + fn + tn)) ELSE 'N/A' END AS accuracy, '' AS direction, note,
 CASE WHEN (SELECT count(*) FROM snapshots WHERE s NOT IN (SELECT s FROM labels)) > 0 THEN (SELECT count(*) FROM snapshots WHERE s NOT IN (SELECT s FROM labels)) || ' snapshots left out: no_labels' ELSE '' END AS warnings, errors, line FROM m""")
def rule_list_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule list's metrics under the published header, bad lines too."""
    net = mesh(spark, sf_dir)
    lines = [("junction angle mean", 145.0, True, "large angles"), ("no such feature", 1.0, False, None), ("junction angle max", None, True, None), ("junctionAngleMinDegrees", 100.0, False, None)]
    table = spark.createDataFrame(lines, "feature string, threshold double, require_above boolean, note string")
    good, _ = rules.rules_of(table)
    metrics = rules.rule_metrics(_features(net, "junction"), neighbours(net.polygons), net.labels, good)
    return rule_metrics_table(rules.rule_report(metrics, table, evaluate.skipped(net.vertices, net.polygons, net.labels)))


@query(""", conn AS (
  SELECT DISTINCT p.s, p.a, p.b, CASE WHEN m.v IS NULL THEN e.v1 ELSE e.v2 END AS v FROM pairs p JOIN edge e ON e.s = p.s AND (e.p = p.a OR e.p = p.b)
  LEFT JOIN member m ON m.s = p.s AND m.a = p.a AND m.b = p.b AND m.v = e.v1 LEFT JOIN member n ON n.s = p.s AND n.a = p.a AND n.b = p.b AND n.v = e.v2 WHERE (m.v IS NULL) <> (n.v IS NULL)),
rest AS (
  SELECT p.s, p.a, p.b, r.v FROM pairs p JOIN ring r ON r.s = p.s AND (r.p = p.a OR r.p = p.b) EXCEPT SELECT * FROM conn EXCEPT SELECT * FROM member)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, coalesce(c.t, '') AS connecting, coalesce(o.t, '') AS other FROM pairs
LEFT JOIN (SELECT s, a, b, string_agg(v, ':' ORDER BY v) AS t FROM conn GROUP BY ALL) c USING (s, a, b) LEFT JOIN (SELECT s, a, b, string_agg(v, ':' ORDER BY v) AS t FROM rest GROUP BY ALL) o USING (s, a, b)""")
def pair_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = relations(neighbours(net.polygons).drop("n_shared"), _cells(net))
    return out.select(*PAIR, F.array_join("connecting_vertices", ":").alias("connecting"), F.array_join("other_vertices", ":").alias("other"))


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, p AS polygon_id FROM polygons q WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.s = q.s AND e.p = q.p AND (lo + hi) % 11 = 0)")
def cascade_delete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return topology.without_lines(net.polygons, net.lines.where("(v1 + v2) % 11 = 0")).select("snapshot_id", "polygon_id")


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, p AS polygon_id, string_agg(v, ':' ORDER BY i) AS ring FROM ring GROUP BY s, p")
def rings_counter_clockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other ring is turned round first."""
    net = mesh(spark, sf_dir)
    ids = F.when(F.col("polygon_id") % 2 == 0, F.reverse("vertex_ids")).otherwise(F.col("vertex_ids"))
    turned = net.polygons.withColumn("vertex_ids", ids)
    area = cell_geometry(rings(net.vertices, turned)).select("snapshot_id", "polygon_id", "signed_area")
    ring = faces.counter_clockwise(F.col("vertex_ids"), F.col("signed_area"))
    return turned.join(area.hint("merge"), ["snapshot_id", "polygon_id"]).select("snapshot_id", "polygon_id", F.array_join(ring, ":").alias("ring"))


@query(""", numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY a, b) AS k FROM labels)
SELECT s AS snapshot_id, k AS line, CASE WHEN k % 6 NOT IN (3, 5) THEN a END AS first_id, CASE WHEN k % 6 NOT IN (3, 5) THEN b END AS second_id,
 CASE k % 6 WHEN 0 THEN t WHEN 1 THEN -1 WHEN 2 THEN -1 END AS division_time, CASE k % 6 WHEN 2 THEN 'label_time_unreadable' WHEN 3 THEN 'label_without_ids' WHEN 5 THEN 'label_without_ids' END AS problem
FROM numbered WHERE k % 6 <> 4""")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of label files, some without ids, without a readable time, or blank: the labels and what is wrong with the others."""
    labels = mesh(spark, sf_dir).labels
    k = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("first_id", "second_id"))
    a, b, t = (F.col(c).cast("string") for c in ("first_id", "second_id", "division_time"))
    kind, said = F.col("k") % 6, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = F.when(kind == 0, said(a, ",", b, ",", t)).when(kind == 1, said(" ", b, "; ", a)).when(kind == 2, said(a, " ", b, "\tsoon")).when(kind == 3, said(a, " only")).when(kind == 4, said("  ")).otherwise(said("x,", b, ",", t))
    lines = labels.withColumn("k", k).select("snapshot_id", F.col("k").cast("long").alias("line"), text.alias("text"))
    header = labels.select("snapshot_id").distinct().select("snapshot_id", F.lit(0).cast("long").alias("line"), F.lit("first,second,time").alias("text"))
    found = plain_label_lines(header.union(lines))
    return found.select("snapshot_id", "line", *[F.col(c).cast("long").alias(c) for c in ("first_id", "second_id", "division_time")], "problem")


@query(""", est AS (SELECT s, a, b FROM junction WHERE mean >= 145), every AS (
  SELECT s, a, b, bool_or(e) AS e, bool_or(r) AS r FROM (SELECT s, a, b, true AS e, false AS r FROM est UNION ALL SELECT s, a, b, false, true FROM labels UNION ALL SELECT s, a, b, false, false FROM pairs) GROUP BY s, a, b)
SELECT p.s AS snapshot_id, (SELECT count(*) FROM vertices v WHERE v.s = p.s) AS vertices, (SELECT count(*) FROM (SELECT DISTINCT e.s, lo, hi FROM edge e) e WHERE e.s = p.s) AS lines,
 (SELECT count(*) FROM polygons q WHERE q.s = p.s) AS polygons, count(*) FILTER (r) AS real_pairs, count(*) FILTER (e) AS estimated_pairs, count(*) FILTER (e AND r) AS true_positive,
 count(*) FILTER (e AND NOT r) AS false_positive, count(*) FILTER (r AND NOT e) AS false_negative, count(*) FILTER (NOT r AND NOT e) AS true_negative FROM every p GROUP BY p.s""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine counts of a snapshot: its elements, pairs labelled and inferred, and how they agree."""
    net = mesh(spark, sf_dir)
    flags = evaluate.flagged(neighbours(net.polygons), _candidates(net), net.labels)
    elements = places.element_counts(vertices=net.vertices, lines=net.lines, polygons=net.polygons)
    return elements.join(evaluate.counts(flags, ["snapshot_id"]).drop("neighbor_pairs").hint("merge"), "snapshot_id")
