"""The union of two cells that meet along several chains, against areas and points worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from polynet.operators.cells import cell_geometry, rings
from polynet.operators.features import pair_features, union_rings

#: Two combs that meet at x = 0 in three stretches, with two square holes of sides 2 between them.
LEFT = [(-4, 0), (0, 0), (0, 1), (-1, 1), (-1, 3), (0, 3), (0, 4), (-1, 4), (-1, 6), (0, 6), (0, 7), (-4, 7)]
RIGHT = [(4, 0), (4, 7), (0, 7), (0, 6), (1, 6), (1, 4), (0, 4), (0, 3), (1, 3), (1, 1), (0, 1), (0, 0)]
#: A notch that reaches the corner (0, 0): its hole touches the outline there.
NOTCHED = [(-4, 0), (0, 0), (-1, 1), (0, 2), (0, 4), (-4, 4)]
OTHER = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 2), (1, 1)]
#: Touches nothing but one corner of OTHER.
CORNER = [(4, 4), (6, 4), (6, 6), (4, 6)]


def shapes(spark, *polygons, turn=()):
    points = {p: i for i, p in enumerate(dict.fromkeys(p for ring in polygons for p in ring))}
    vertices = spark.createDataFrame([(1, i, float(x), float(y)) for (x, y), i in points.items()], "snapshot_id long, vertex_id int, x double, y double")
    ids = [[points[p] for p in (ring[::-1] if i in turn else ring)] for i, ring in enumerate(polygons)]
    table = spark.createDataFrame([(1, i, r) for i, r in enumerate(ids)], "snapshot_id long, polygon_id int, vertex_ids array<int>")
    pairs = spark.createDataFrame([(1, 0, 1)], "snapshot_id long, first_id int, second_id int")
    return pairs, cell_geometry(rings(vertices, table))


@pytest.mark.parametrize("turn", [(), (0,), (1,), (0, 1)])
def test_two_holes_are_rings_of_their_own(spark, turn):
    pairs, cells = shapes(spark, LEFT, RIGHT, turn=turn)
    found = [(r.ring, r.area, r.perimeter, r.is_hole) for r in union_rings(pairs, cells).orderBy("ring").collect()]
    assert found == [(1, 56.0, 30.0, False), (2, 4.0, 8.0, True), (3, 4.0, 8.0, True)]
    r = pair_features(pairs, cells, ("union",)).first()
    assert r.unionCircularity == pytest.approx(4 * math.pi * 64 / 46**2)
    assert r.unionConvexDeficiency == pytest.approx((56 - 64) / 64)
    assert r.sharedEdgeUnionCentroidDistance == pytest.approx(0)


@pytest.mark.parametrize("turn", [(), (0,), (1,)])
def test_hole_at_the_outline(spark, turn):
    pairs, cells = shapes(spark, NOTCHED, OTHER, turn=turn)
    found = [(r.ring, r.area, r.is_hole) for r in union_rings(pairs, cells).orderBy("ring").collect()]
    assert found == [(1, 32.0, False), (2, 2.0, True)]
    r = pair_features(pairs, cells, ("union",)).first()
    assert r.unionCircularity == pytest.approx(4 * math.pi * 34 / (24 + 4 * math.sqrt(2)) ** 2)
    # (0, 0) is a point of both rings: x varies by 4 * 16 + 2, y about its mean of 19 / 10 by less, so the axis lies across the shared edge.
    assert r.sharedEdgeUnionAxisAngleDegrees == pytest.approx(90, abs=1e-9)


def test_one_place_is_one_ring(spark):
    for shape in ((OTHER, CORNER), ([(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 0), (2, 0), (2, 1), (1, 1)])):
        pairs, cells = shapes(spark, *shape)
        assert union_rings(pairs, cells).count() == 0
        r, areas = pair_features(pairs, cells, ("union",)).first(), cells.agg(F.sum("area")).first()[0]
        assert areas > 0 and r.unionCircularity > 0
    pairs, cells = shapes(spark, OTHER, CORNER)
    assert union_rings(pairs.limit(0), cells).count() == 0
