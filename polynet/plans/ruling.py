"""Registered queries of rule lists, exceptions, sweeps and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import keep
from ..operators import evaluate, matching, places, rules
from ..operators.adjacency import neighbours
from ..sources import alldata
from ..sources.mesh import mesh
from .catalogue import _COUNTS, _FLAGS, _RATIOS, FEATURE, PAIR, THRESHOLD, _candidates, _cells, _features, _r, _rounded, query

RULES = [rules.Rule(FEATURE, 145.0, note="mean"), rules.Rule("junctionAngleMaxDegrees", 160.0, note="max"), rules.Rule("junctionAngleDifferenceDegrees", 20.0, above=False)]


def _exceptions(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("first_id") + 2 * F.col("second_id") + F.col("snapshot_id")) % 11 == 0)


@query(""", rule AS (SELECT * FROM (VALUES (0, 'junctionAngleAverageDegrees', 145.0::DOUBLE, '>= cutoff', 'mean'), (1, 'junctionAngleMaxDegrees', 160.0, '>= cutoff', 'max'), (2, 'junctionAngleDifferenceDegrees', 20.0, '<= cutoff', NULL)) r(rule_id, feature_key, threshold, comparison, note)),
flags AS (
  SELECT r.*, j.s, CASE rule_id WHEN 0 THEN mean >= 145 WHEN 1 THEN hi >= 160 ELSE hi - lo <= 20 END AS est, l.s IS NOT NULL AS lab
  FROM junction j CROSS JOIN rule r LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b WHERE (j.a + 2 * j.b + j.s) % 11 <> 0 AND j.s IN (SELECT s FROM labels)),
n AS (""" + _COUNTS.format(key="rule_id, feature_key, threshold, comparison, note,") + """),
m AS (SELECT *, true_positive::DOUBLE AS tp, false_positive AS fp, false_negative AS fn, true_negative AS tn FROM n),
f AS (SELECT rule_id, count(DISTINCT s) AS files_processed, count(DISTINCT s) FILTER (est) AS files_with_results FROM flags GROUP BY rule_id)
SELECT * EXCLUDE (tp, fp, fn, tn), """ + _RATIOS + " FROM m JOIN f USING (rule_id)")
def rule_list_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    near = neighbours(net.polygons)
    return _rounded(rules.rule_metrics(_features(net, "junction"), near, net.labels, RULES, _exceptions(near)))


@query(""", ranked AS (SELECT s, a, b, row_number() OVER (PARTITION BY s ORDER BY mean DESC, a, b) AS k FROM junction WHERE mean >= 145),
taken AS (
  SELECT s, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM snapshots
  UNION ALL
  SELECT t.s, t.k + 1, CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN used ELSE used || [r.a, r.b] END,
    CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN NULL ELSE r.a END, r.b
  FROM taken t JOIN ranked r ON r.s = t.s AND r.k = t.k + 1)
SELECT s AS snapshot_id, a AS first_id, b AS second_id FROM taken WHERE a IS NOT NULL AND (a + 2 * b + s) % 11 <> 0""")
def exceptions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return rules.without(matching.match(_candidates(net), matching.GREEDY), _exceptions(neighbours(net.polygons))).select(*PAIR)


@query(", x AS (SELECT 1) SELECT j.s AS snapshot_id, j.a AS first_id, j.b AS second_id, round(mean, 4) AS value, (l.s IS NOT NULL)::INT AS observed_division, (mean >= 140)::INT AS estimated_division_140, (mean >= 150)::INT AS estimated_division_150, (mean >= 160)::INT AS estimated_division_160 FROM junction j LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b")
def sweep_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = rules.sweep_wide(_features(net, "junction"), net.labels, FEATURE, [140.0, 150.0, 160.0])
    return out.withColumn("value", _r(f"{FEATURE}_value")).drop(f"{FEATURE}_value")


@query(""", x AS (SELECT j.s, j.a, j.b, a.cx AS x1, a.cy AS y1, b.cx AS x2, b.cy AS y2 FROM junction j JOIN cell a ON a.s = j.s AND a.p = j.a JOIN cell b ON b.s = j.s AND b.p = j.b WHERE mean >= 145)
SELECT s AS snapshot_id, a AS first_id, b AS second_id, round(x1, 4) AS first_x, round(y1, 4) AS first_y, round(x2, 4) AS second_x, round(y2, 4) AS second_y, round((x1 + x2) / 2, 4) AS mid_x, round((y1 + y2) / 2, 4) AS mid_y,
 round(degrees(atan2(abs(y2 - y1), abs(x2 - x1))), 4) AS acute_angle, round(degrees(abs(atan2(y2 - y1, x2 - x1))), 4) AS angle_180 FROM x""")
def division_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = rules.division_positions(_candidates(net), _cells(net))
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(", x AS (SELECT j.mean AS v, l.s IS NOT NULL AS real FROM junction j LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b) SELECT real, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75 FROM x GROUP BY real")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = rules.feature_summary(_features(net, "junction"), net.labels, FEATURE)
    return out.select("real", "n", *[_r(c).alias(c) for c in ("mean", "q25", "q50", "q75")])


@query(", x AS (SELECT 1) SELECT s AS snapshot_id, (SELECT count(*) FROM vertices v WHERE v.s = p.s) AS vertices, (SELECT count(*) FROM (SELECT DISTINCT e.s, lo, hi FROM edge e) e WHERE e.s = p.s) AS lines, count(*) AS polygons, (SELECT count(*) FROM labels l WHERE l.s = p.s) AS labels FROM polygons p GROUP BY s")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return places.element_counts(vertices=net.vertices, lines=net.lines, polygons=net.polygons, labels=net.labels)


@query(', x AS (SELECT s, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM vertices GROUP BY s) SELECT s AS snapshot_id, round(a - 20, 4) AS "left", round(b - 20, 4) AS top, round(greatest(10, c - a + 40), 4) AS width, round(greatest(10, d - b + 40), 4) AS height FROM x')
def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = places.extents(mesh(spark, sf_dir).vertices)
    return out.select("snapshot_id", *[_r(c).alias(c) for c in ("left", "top", "width", "height")])


@query(""", x AS (SELECT j.s, j.a, j.b, rank() OVER (PARTITION BY j.s ORDER BY mean DESC, j.a, j.b) AS k, mean FROM junction j WHERE mean >= 145)
SELECT s AS snapshot_id, count(*) AS candidates, round(max(mean - 145), 4) AS best_score, arg_min(a, k) AS best_first, arg_min(b, k) AS best_second FROM x GROUP BY s""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of each snapshot's ranking under the flagship rule."""
    found = rules.estimates(_features(mesh(spark, sf_dir), "junction"), [rules.Rule(FEATURE, THRESHOLD)])
    top = F.struct("score", -F.col("first_id"), -F.col("second_id"))
    return found.groupBy("snapshot_id").agg(F.count("*").alias("candidates"), _r(F.max("score")).alias("best_score"), F.max_by("first_id", top).alias("best_first"), F.max_by("second_id", top).alias("best_second"))


_SWEPT = (130.0, 140.0, 150.0, 160.0)


@query(f""", th AS (SELECT unnest({list(_SWEPT)})::DOUBLE AS th),
ranked AS (SELECT th, s, a, b, row_number() OVER (PARTITION BY th, s ORDER BY mean DESC, a, b) AS k FROM junction CROSS JOIN th WHERE mean >= th),
taken AS (
  SELECT th, s, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM snapshots CROSS JOIN th
  UNION ALL
  SELECT t.th, t.s, t.k + 1, CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN used ELSE used || [r.a, r.b] END,
    CASE WHEN list_contains(used, r.a) OR list_contains(used, r.b) THEN NULL ELSE r.a END, r.b
  FROM taken t JOIN ranked r ON r.th = t.th AND r.s = t.s AND r.k = t.k + 1),
flags AS (
  SELECT th.th AS threshold, t.a IS NOT NULL AS est, l.s IS NOT NULL AS lab FROM junction j CROSS JOIN th
  LEFT JOIN taken t ON t.th = th.th AND t.s = j.s AND t.a = j.a AND t.b = j.b LEFT JOIN labels l ON l.s = j.s AND l.a = j.a AND l.b = j.b WHERE j.s IN (SELECT s FROM labels)),
n AS (""" + _COUNTS.format(key="threshold,") + "), m AS (SELECT *, true_positive::DOUBLE AS tp, false_positive AS fp, false_negative AS fn, true_negative AS tn FROM n) SELECT * EXCLUDE (tp, fp, fn, tn), " + _RATIOS + " FROM m")
def greedy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return _rounded(rules.matched_sweep(_features(net, "junction"), neighbours(net.polygons), net.labels, FEATURE, list(_SWEPT)))


@query(_FLAGS.replace("mean >= 145 AS est", "floor(mean / 10) * 10 AS bin") + "SELECT lab AS real, bin, count(*) AS n FROM flags GROUP BY ALL")
def feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    return rules.feature_histogram(_features(net, "junction"), net.labels, FEATURE, 10.0)


@query(", x AS (SELECT t, mean FROM junction JOIN labels USING (s, a, b)) SELECT t::INT AS division_time, count(*) AS n, round(avg(mean), 4) AS mean, round(min(mean), 4) AS least, round(max(mean), 4) AS most FROM x GROUP BY t")
def temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = mesh(spark, sf_dir)
    out = rules.temporal_summary(_features(net, "junction"), net.labels, FEATURE)
    return out.withColumns({c: _r(c) for c in ("mean", "least", "most")})


@query(_FLAGS + """SELECT f.s::VARCHAR AS snapshot_id, f.a AS first_id, f.b AS second_id, lab AS observed_division, coalesce(t, -1)::INT AS division_time, est AS estimated, round(mean, 4) AS mean_angle,
 sum(est::INT) OVER (PARTITION BY f.s)::BIGINT AS estimated_pairs FROM flags f JOIN junction j ON j.s = f.s AND j.a = f.a AND j.b = f.b LEFT JOIN labels l ON l.s = f.s AND l.a = f.a AND l.b = f.b""")
def stored_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, inferred pairs and counts as read back from all-data documents."""
    net = mesh(spark, sf_dir)
    features = keep(_features(net, "junction"), "features")
    estimated = matching.candidates(features, FEATURE, THRESHOLD)
    metrics = evaluate.with_ratios(evaluate.counts(evaluate.flagged(features, estimated, net.labels), ["snapshot_id"]))
    documents = keep(alldata.all_data_json(net, features, estimated, rules.Rule(FEATURE, THRESHOLD), metrics), "documents")
    docs = documents.select(F.col("snapshot_id").cast("string").alias("snapshot_id"), F.from_json("json", alldata.all_data_schema()).alias("d")).select("snapshot_id", "d.*")
    back = alldata.all_data_of(docs)
    out = back.geometry.join(back.estimated.withColumn("estimated", F.lit(True)), PAIR, "left").join(back.metrics, "snapshot_id")
    long = [F.col(c).cast("long").alias(c) for c in ("first_id", "second_id")]
    return out.select("snapshot_id", *long, "observed_division", "division_time", F.coalesce("estimated", F.lit(False)).alias("estimated"), _r(FEATURE).alias("mean_angle"), "estimated_pairs")
