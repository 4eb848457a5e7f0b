import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynet.functions.quantiles import quantiles
from polynet.operators import faces, places
from polynet.sources.networks import NETWORK, networks_of


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_equal_numpy(spark, few):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [float(rng.randrange(3)) for _ in range(101)], "c": [7.5] * 40, "d": [1e300 * rng.random() ** 40 for _ in range(60)], "e": [-2.0], None: [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("f", None)]
    got = {r.k: r for r in quantiles(spark.createDataFrame([r for r in rows if r[0]], "k string, v double"), ["k"], "v", (0.0, 0.25, 0.5, 0.9, 1.0), few).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    for k, r in got.items():
        assert [r.q0, r.q25, r.q50, r.q90, r.q100] == pytest.approx(list(np.quantile(groups[k], [0, 0.25, 0.5, 0.9, 1.0])), rel=1e-12)


def test_least_rotation(spark):
    rng = random.Random(2)
    rings = [[rng.randrange(k) for _ in range(rng.randrange(1, 14))] for k in (1, 2, 3, 50) for _ in range(60)] + [[], [1, None, 0, None], None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, ids array<int>")
    got = {r.i: r.c for r in rows.select("i", faces.canonical_ring(F.col("ids")).alias("c")).collect()}
    order = lambda r: [(v is not None, v or 0) for v in r]
    for i, r in enumerate(rings):
        assert got[i] == (min((r[j:] + r[:j] for j in range(len(r))), key=order) if r else r)


def test_long_rings_have_keys_in_linear_time(spark):
    n = 20_000
    ring = [(i * 7919) % n for i in range(n)]
    worst = [0] * (n - 1) + [1]
    rows = spark.createDataFrame([(0, ring), (1, ring[777:] + ring[:777]), (2, ring[::-1]), (3, worst), (4, worst[-1:] + worst[:-1])], "i int, ids array<int>")
    key = [r.k for r in rows.select("i", faces.cycle_key(F.col("ids")).alias("k")).orderBy("i").collect()]
    assert key[0] == key[1] == key[2] != key[3] == key[4]


@pytest.mark.parametrize("cell", [None, 2.0])
def test_points_in_polygons_of_all_sizes(spark, cell):
    rng = random.Random(4)
    squares = [(0.0, 0.0, 1e6), (3.0, 3.0, 1.0), (3.25, 3.25, 0.001), (-5.0, -5.0, 10.0), (7.0, 7.0, 0.0)]
    point = "array<struct<v:int,x:double,y:double>>"
    rings = spark.createDataFrame([(0, i, [(0, x, y), (1, x + s, y), (2, x + s, y + s), (3, x, y + s)]) for i, (x, y, s) in enumerate(squares)], f"snapshot_id int, polygon_id int, ring {point}")
    points = [(0, i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(300)] + [(0, 300, 3.2505, 3.2505), (0, 301, 5e5, 9e5), (1, 302, 1.0, 1.0)]
    got = {(r.point_id, r.polygon_id) for r in places.holding_polygons(spark.createDataFrame(points, "snapshot_id int, point_id int, x double, y double"), rings, cell).collect()}
    assert got == {(p, i) for s, p, x, y in points for i, (a, b, w) in enumerate(squares) if s == 0 and a <= x < a + w and b <= y < b + w}


def test_null_rings_and_repeated_polygons_are_issues(spark):
    corners = [{"id": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    polygons = [{"id": 5, "vertexIds": None}, {"id": 6, "vertexIds": [0, 1, 2]}, {"id": 6, "vertexIds": [0, 1, 2, 3]}, {"id": 7, "vertexIds": []}, {"id": 8}]
    docs = spark.read.schema(NETWORK).json(spark.createDataFrame([(json.dumps({"vertices": corners, "polygons": polygons}),)], "j string").rdd.map(lambda r: r.j)).withColumn("snapshot_id", F.lit("a"))
    net, issues = networks_of(docs)
    assert [(r.polygon_id, r.vertex_ids) for r in net.polygons.collect()] == [(6, [0, 1, 2, 3])]
    assert sorted((r.code, r.detail) for r in issues.collect()) == [("polygon_repeated", "6"), ("polygon_too_small", "5"), ("polygon_too_small", "7"), ("polygon_too_small", "8")]
