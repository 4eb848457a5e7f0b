"""What lists many rows from few is dealt to all tasks, though it takes so few bytes that Spark would put it into one."""

import re

import pytest
from pyspark.sql import functions as F

from polynet.operators import evaluate, rules
from polynet.operators.adjacency import neighbours, with_cells
from polynet.operators.cells import rings
from polynet.plans import catalogue, ruling  # noqa: F401 (the latter registers its queries with the first)
from polynet.sources.mesh import customer_mesh, mesh

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_one_task_lists_all_cells(spark):
    listed = mesh(spark, SF).polygons.select("snapshot_id", F.explode("vertex_ids"))
    assert listed.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_snapshots_of_the_customer_mesh_are_dealt(spark):
    assert "REPARTITION_BY_NUM" in plan(customer_mesh(spark, SF).polygons)


def test_members_stay_dealt_however_small(spark):
    polygons = spark.createDataFrame([(s, p, [p, p + 1, p + 2]) for s in range(3) for p in range(4)], "snapshot_id long, polygon_id int, vertex_ids array<int>")
    found = neighbours(polygons)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert "REPARTITION_BY_COL" not in plan(found)
    assert sorted((r.snapshot_id, r.first_id, r.second_id, r.n_shared) for r in found.collect()) == [(s, p, p + 1, 2) for s in range(3) for p in range(3)]


CELLS = "snapshot_id long, polygon_id int, vertex_ids array<int>"


def test_pairs_are_dealt_before_they_meet_whole_cells(spark):
    pairs = spark.createDataFrame([(s, p, p + 1) for s in range(3) for p in range(4)], "snapshot_id long, first_id int, second_id int")
    cells = spark.createDataFrame([(s, p, [p, p + 1]) for s in range(3) for p in range(4)], CELLS)
    found = with_cells(pairs, cells)
    assert plan(found).count("REPARTITION_BY_NUM") == 2
    assert sorted((r.snapshot_id, r.a.polygon_id, r.b.polygon_id) for r in found.collect()) == [(s, p, p + 1) for s in range(3) for p in range(3)]


def test_listed_corners_are_dealt_before_they_meet_vertices(spark):
    vertices = spark.createDataFrame([(s, v, float(v % 2), float(v // 2)) for s in range(3) for v in range(4)], "snapshot_id long, vertex_id int, x double, y double")
    polygons = spark.createDataFrame([(s, 0, [0, 1, 3]) for s in range(3)] + [(0, 1, [0, 1, 9])], CELLS)
    found = rings(vertices, polygons)
    assert plan(found).count("REPARTITION_BY_NUM") == 1
    assert sorted((r.snapshot_id, r.polygon_id, [p.v for p in r.ring]) for r in found.collect()) == [(s, 0, [0, 1, 3]) for s in range(3)]


def test_grid_points_are_dealt_before_they_meet_customers_and_parts(spark):
    assert len(re.findall(r"hashpartitioning\((?:c_custkey|p_partkey)#\d+L?, \d+\), REPARTITION_BY_NUM", plan(mesh(spark, SF).vertices))) == 2


@pytest.mark.parametrize(
    ("name", "dealt_by_pair"), [("compare_results", 2), ("confusion_by_snapshot", 1), ("division_angles", 0), ("feature_histogram", 1)]
)
def test_pairs_stay_dealt_when_they_meet_labels_and_results(spark, name, dealt_by_pair):
    text = plan(catalogue.QUERIES[name](spark, SF))
    by_pair = re.findall(r"hashpartitioning\(snapshot_id#\w+, first_id#\w+, second_id#\w+(?:, observed#\w+)?, \d+\), REPARTITION_BY_NUM", text)
    assert len(set(by_pair)) >= dealt_by_pair
    if name == "division_angles":  # its second meeting with the cells, for their centroids, as the first one
        assert len(re.findall(r"hashpartitioning\(snapshot_id#\w+, second_id#\w+, \d+\), REPARTITION_BY_NUM", text)) == 2


@pytest.mark.parametrize(("module", "name"), [(rules, "feature_summary"), (evaluate, "sweep")])
def test_pairs_stay_dealt_in_tables_written_on_the_way(spark, monkeypatch, module, name):
    plain, seen = module.keep, []
    monkeypatch.setattr(module, "keep", lambda df, *a: seen.append(plan(df)) or plain(df, *a))
    rows = spark.createDataFrame([(0, 1, 2, 90.0), (0, 2, 3, 150.0)], "snapshot_id long, first_id int, second_id int, value double")
    labels = rows.where("value > 100").select("snapshot_id", "first_id", "second_id")
    more = ([100.0],) if name == "sweep" else ()
    getattr(module, name)(rows, labels, "value", *more).collect()
    assert re.search(r"hashpartitioning\(snapshot_id#\w+, first_id#\w+, second_id#\w+, \d+\), REPARTITION_BY_NUM", seen[0])
