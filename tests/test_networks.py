import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from polynet.functions.geometry import _hull
from polynet.operators import matching, topology
from polynet.operators.adjacency import neighbours, share_k_pairs
from polynet.operators.cells import cell_geometry, rings
from polynet.plans import catalogue
from polynet.sources import networks

SF = "/root/testdata/sf0.001"
TABLES = "nation customer part lineitem".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["cell_measures", "pair_shared_edge", "junction_angles", "estimate_unconstrained", "estimate_greedy", "metrics_total", "topology_qa"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_share_k_pairs_equals_all_pairs(spark):
    random.seed(1)
    members = [(random.randrange(12), random.randrange(20)) for _ in range(80)] + [(None, 1), (3, None)]
    sets = {}
    for o, m in members:
        if o is not None and m is not None:
            sets.setdefault(o, set()).add(m)
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 2}
    got = share_k_pairs(spark.createDataFrame(members, "o int, m int"), [], "o", "m", 2).collect()
    assert {tuple(r) for r in got} == want


def test_cell_geometry_of_known_shapes(spark):
    points = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 2), (0, 2), (8, 0), (8, 2)])], "snapshot_id string, vertex_id int, x double, y double")
    cells = spark.createDataFrame([("s", 0, [0, 1, 2, 3]), ("s", 1, [2, 5, 4, 1]), ("s", 2, [0, 1]), ("s", 3, [0, 1, 99])], "snapshot_id string, polygon_id int, vertex_ids array<int>")
    got = {r.polygon_id: r for r in cell_geometry(rings(points, cells)).collect()}
    assert set(got) == {0, 1}
    assert (got[0].area, got[0].perimeter, got[0].cx, got[0].cy, got[0].aspect_ratio) == (8.0, 12.0, 2.0, 1.0, 2.0)
    assert got[1].area == 8.0 and got[1].signed_area == -8.0
    assert [tuple(r) for r in neighbours(cells.where("polygon_id < 2")).collect()] == [("s", 0, 1, 2)]
    assert [tuple(r) for r in topology.missing_lines(spark.createDataFrame([("s", 1, 0)], "snapshot_id string, v1 int, v2 int"), cells.where("polygon_id = 0")).orderBy("v1", "v2").collect()] == [("s", 0, 3), ("s", 1, 2), ("s", 2, 3)]


def test_hull_area():
    assert _hull(np.array([0, 2, 2, 0, 1, 1]), np.array([0, 0, 2, 2, 1, 0])) == 4.0
    assert _hull(np.arange(3), np.arange(3)) == 0.0


def test_global_matching_is_heaviest():
    random.seed(2)
    for _ in range(60):
        edges = random.sample(list(itertools.combinations(range(7), 2)), random.randrange(1, 9))
        pdf = pd.DataFrame([(0, a, b, round(random.random(), 3)) for a, b in edges], columns=["snapshot_id", "first_id", "second_id", "score"])
        best = 0.0
        for n in range(len(edges) + 1):
            for pick in itertools.combinations(range(len(edges)), n):
                cells = [c for i in pick for c in edges[i]]
                if len(cells) == len(set(cells)):
                    best = max(best, sum(pdf.score[i] for i in pick))
        exact, greedy = matching.global_pairs(pdf), matching.greedy_pairs(pdf)
        assert math.isclose(exact.score.sum(), best)
        assert exact.score.sum() >= greedy.score.sum() - 1e-12
        for m in (exact, greedy):
            cells = m.first_id.tolist() + m.second_id.tolist()
            assert len(cells) == len(set(cells))


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"vertices": [{"id": 0, "x": 0, "y": 0}, {"id": 1, "x": 1, "y": 0}, {"id": 2, "x": 0, "y": 1}], "lines": [{"id": 0, "startVertexId": 0, "endVertexId": 1}, {"id": 1, "startVertexId": 0, "endVertexId": 9}], "polygons": [{"id": 0, "vertexIds": [0, 1, 2]}, {"id": 1, "vertexIds": [0, 1]}, {"id": 2, "vertexIds": [0, 1, 9]}]}')
    net, issues = networks.read_networks(spark, str(tmp_path))
    assert [r.line_id for r in net.lines.collect()] == [0]
    assert [r.polygon_id for r in net.polygons.collect()] == [0]
    assert {(r.code, r.detail) for r in issues.collect()} == {("line_without_vertex", "1"), ("polygon_without_vertex", "2"), ("polygon_too_small", "1")}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a_real_division_pairs.csv").write_text("real_division_pair\n1 2 30\n\n2;1;31\n4,5\n6\n7 8 x\n")
    got = {tuple(r) for r in networks.read_labels(spark, str(tmp_path / "l")).collect()}
    assert got == {("a", 1, 2, 31), ("a", 4, 5, -1), ("a", 7, 8, -1)}
    (tmp_path / "l" / "a_real_division_pairs.txt").write_text("9 9 9\n")
    (tmp_path / "l" / "b.csv").write_text('# made by hand\nfile_name,first,second,time\n"b.json",3,"4.0",12\n5,6,7.0\n6,5,8\nb.json,1,8,9,1,30,0.5\nb.json,2,1,2,0,-1,0.5\nx,y\n')
    assert {tuple(r) for r in networks.read_labels(spark, str(tmp_path / "l")).where("snapshot_id = 'a'").collect()} == got
    mixed = networks.read_mixed_labels(spark, str(tmp_path / "l")).where("snapshot_id = 'b'")
    assert {tuple(r)[1:] for r in mixed.collect()} == {(3, 4, 12), (5, 6, 7), (8, 9, 30)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("-1 2 3\n1 2 30\n 2\t1 31 \n4,5 6\n6 7 x\n\n8\n9 10\n")
    assert {tuple(r) for r in networks.read_strict_labels(spark, str(tmp_path / "s")).collect()} == {("a", 1, 2, 31), ("a", 9, 10, -1)}
    (tmp_path / "r.csv").write_text("feature,cutoff_value,below_or_above,note\narea,12.5,below,x\nlength,no,above,\n")
    assert [tuple(r) for r in networks.read_rules(spark, str(tmp_path / "r.csv")).collect()] == [("area", 12.5, False, "x"), ("length", None, True, None)]
    assert networks.read_exceptions(spark, str(tmp_path / "r.csv")).count() == 0
