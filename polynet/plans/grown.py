"""Registered queries on networks whose snapshots grow with the tables; their SQL ends as that of the queries on the fixed mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluate, matching
from ..sources.mesh import customer_mesh
from .catalogue import _MESH, FEATURE, ORACLE_SQL, PAIR, _candidates, _cells, _features, _flags, _r, _rounded, query, whole_sides

_GROWN = """
WITH RECURSIVE vertices AS (
  SELECT s, v, 10 * (v % 13) + 4 * (b - floor(b)) - 2 AS x, 10 * (v // 13) + 4 * (b / 7 - floor(b / 7)) - 2 AS y
  FROM (SELECT c_custkey::BIGINT // 117 AS s, c_custkey::BIGINT % 117 AS v, c_acctbal::DOUBLE AS b FROM customer)),
polygons AS (
  SELECT s, p, p // 5 AS r, (p // 5) % 2 + 2 * (p % 5) AS c FROM (SELECT s, max(v) AS top FROM vertices GROUP BY s), (SELECT unnest(range(40))::BIGINT AS p)
  WHERE 13 * (p // 5 + 1) + (p // 5) % 2 + 2 * (p % 5) + 2 <= top),
""" + _MESH[_MESH.index("ring AS (") :]


def _sql(name: str) -> str:
    return _GROWN + ORACLE_SQL[name].removeprefix(_MESH)


@query(_sql("cell_measures"))
def grown_cell_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(customer_mesh(spark, sf_dir)).select("snapshot_id", "polygon_id", *[_r(c).alias(c) for c in ("area", "perimeter", "cx", "cy", "aspect_ratio", "circularity")], "vertex_count")


def _pair_features(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    out = _features(customer_mesh(spark, sf_dir), family)
    return out.select(*PAIR, *[_r(c).alias(c) for c in out.columns if c not in PAIR])


@query(_sql("pair_stats"))
def grown_pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_features(spark, sf_dir, "stats")


@query(_sql("pair_shared_edge"))
def grown_pair_shared_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_features(spark, sf_dir, "shared_edge")


@query(whole_sides(_sql("pair_union_shape")))
def grown_pair_union_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_features(spark, sf_dir, "union")


@query(_sql("junction_angles"))
def grown_junction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_features(spark, sf_dir, "junction")


@query(_sql("estimate_unconstrained"))
def grown_estimate_unconstrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.match(_candidates(customer_mesh(spark, sf_dir)), matching.UNCONSTRAINED)
    return out.select(*PAIR, _r("value").alias("value"), _r("score").alias("score"))


@query(_sql("estimate_global"))
def grown_estimate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(_candidates(customer_mesh(spark, sf_dir)), matching.GLOBAL).select(*PAIR)


@query(_sql("confusion_by_snapshot"))
def grown_confusion_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counts(_flags(customer_mesh(spark, sf_dir)), ["snapshot_id"])


@query(_sql("metrics_total"))
def grown_metrics_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.totals(evaluate.counts(_flags(customer_mesh(spark, sf_dir)), ["snapshot_id"]), []))


@query(_sql("threshold_sweep"))
def grown_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = customer_mesh(spark, sf_dir)
    return _rounded(evaluate.sweep(_features(net, "junction"), net.labels, FEATURE, [90.0 + 5 * i for i in range(19)]))
