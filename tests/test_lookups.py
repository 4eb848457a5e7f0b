import json

import duckdb
import pytest
from pyspark.sql import functions as F

from polynet.operators import evaluate, faces, pixels, rules, topology
from polynet.plans import catalogue, lookups  # noqa: F401 (registers its queries)
from polynet.sources import alldata, networks, sinks

from .test_networks import SF, TABLES, rows_of


@pytest.mark.parametrize("name", ["compare_all_features", "polygons_by_vertices", "snapped_points", "polygon_order_by_points", "snapshots_skipped", "snapshot_counts", "network_issues", "rule_list_report", "pair_surroundings", "cascade_delete_lines", "rings_counter_clockwise"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got.astype(str)) == rows_of(expected.astype(str))


def test_documents_that_repeat_or_lack_vertices(spark, tmp_path):
    points = [(0, 0.4, 0.5), (1, 4, 0), (2, 4, 2), (1, 5, 0)]
    ends = [(0, 0, 1), (1, 1, 0), (2, 2, 2), (3, 1, 2), (4, 1, 9)]
    doc = {
        "vertices": [{"id": i, "x": x, "y": y} for i, x, y in points],
        "lines": [{"id": i, "startVertexId": a, "endVertexId": b} for i, a, b in ends],
        "polygons": [{"id": 0, "vertexIds": [0, 1, 2]}],
        "neighborPairs": [{"firstPolygonId": 0, "secondPolygonId": 7}],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"lines": doc["lines"]}))
    net, issues = networks.read_networks(spark, str(tmp_path))
    assert {tuple(r)[1:] for r in net.vertices.collect()} == {(0, 0.4, 0.5), (1, 5.0, 0.0), (2, 4.0, 2.0)}
    assert sorted(r.line_id for r in net.lines.collect()) == [0, 1, 2, 3]
    want = {("a", "warning", "line_without_vertex", "4"), ("a", "warning", "vertex_repeated", "1"), ("a", "warning", "pair_without_polygon", "0 7"), ("b", "error", "no_vertices", None)}
    assert {tuple(r) for r in issues.collect()} == want
    net, issues = networks.read_networks(spark, str(tmp_path), tidy=True)
    assert sorted(r.line_id for r in net.lines.collect()) == [0, 3]
    assert {tuple(r)[1:] for r in net.vertices.collect()} == {(0, 0.0, 1.0), (1, 5.0, 0.0), (2, 4.0, 2.0)}
    assert {r.detail for r in issues.where("code = 'line_of_no_length_or_repeated'").collect()} == {"1", "2"}


def test_exceptions_by_full_name_else_by_base_name(spark, tmp_path):
    (tmp_path / "e.csv").write_text("file id1 id2\na.json 2 1\na 5 6\nb 3 4\nc.d 7 8\nbad 1\n")
    got = {tuple(r) for r in networks.read_exceptions(spark, str(tmp_path / "e.csv")).collect()}
    assert got == {("a", 1, 2), ("b", 3, 4), ("c.d", 7, 8)}


def test_first_row_of_a_repeated_pair_counts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Filename,cell_1_id,cell_2_id,observed_division,estimated_division,area_ratio\na,1,2,1,1,0.5\na,2,1,1,0,0.25\na,x,1,1,0,1\n")
    got = [r.asDict() for r in sinks.read_estimations(spark, str(tmp_path / "r.csv")).collect()]
    assert len(got) == 1 and (got[0]["estimated"], got[0]["first_id"], got[0]["second_id"]) == (1, 1, 2)
    pair = lambda a, b, t: {"firstPolygonId": a, "secondPolygonId": b, "time": t}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"vertices": [{"id": 0, "x": 0, "y": 0}], "realDivisions": [pair(2, 1, 9), pair(1, 2, 3)]}))
    assert [tuple(r) for r in alldata.read_all_data(spark, str(tmp_path / "d")).network.labels.collect()] == [("a", 1, 2, 9)]
    labels = spark.createDataFrame([("s", 1, 2, 9, 0), ("s", 1, 2, 3, 1), ("s", 2, 2, 3, 2)], "snapshot_id string, first_id int, second_id int, division_time int, line int")
    cells = spark.createDataFrame([("s", i) for i in range(3)], "snapshot_id string, polygon_id int")
    assert [tuple(r) for r in networks.repaired_labels(labels, cells).collect()] == [("s", 1, 2, 9)]


def test_id_lists(spark):
    texts = ["1, 2;3", " 7 8\t9 ", "1 2", "1 2 2", "1 2 x", "", None, "-1,0,1"]
    got = [r.ids for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(faces.id_list(F.col("t")).alias("ids")).collect()]
    assert got == [[1, 2, 3], [7, 8, 9], None, None, None, None, None, [-1, 0, 1]]


def test_restricted_counts_and_skipped(spark):
    pair = "snapshot_id string, first_id int, second_id int"
    table = lambda rows: spark.createDataFrame(rows, pair)
    near, est, real = table([("a", 0, 1), ("a", 1, 2)]), table([("a", 0, 1), ("a", 0, 2)]), table([("a", 1, 2), ("b", 0, 5)])
    got = {r.snapshot_id: r.asDict() for r in evaluate.restricted_counts(evaluate.flagged(near, est, real), ["snapshot_id"]).collect()}
    assert (got["a"]["estimated_pairs"], got["a"]["false_negative"], got["a"]["dropped_estimated"], got["a"]["dropped_real"]) == (1, 1, 1, 0)
    assert (got["b"]["real_pairs"], got["b"]["dropped_real"]) == (0, 1)


def test_rule_of_an_unknown_column_infers_nothing(spark):
    features = spark.createDataFrame([("a", 0, 1, 150.0)], "snapshot_id string, first_id int, second_id int, known double")
    found = rules.estimates(features, [rules.Rule("known", 145.0), rules.Rule("unknown", 0.0)]).collect()
    assert [r.rule_id for r in found] == [0]


def test_result_tables_and_lines_taken_away(spark):
    est = spark.createDataFrame([("a", 0, 1)], "snapshot_id string, first_id int, second_id int")
    assert [tuple(r) for r in sinks.estimated_pairs_table(est).collect()] == [("a", 0, 1, 1)]
    ratios = spark.createDataFrame([(-1.0, 0.5, 0.25, 1.0, 0.0)], "precision double, recall double, f1 double, specificity double, accuracy double")
    assert tuple(sinks.metrics_table(ratios).first()) == ("N/A", "0.500000", "0.250000", "1.000000", "0.000000")
    cells = spark.createDataFrame([("s", 0, [0, 1, 2]), ("s", 1, [2, 3, 4])], "snapshot_id string, polygon_id int, vertex_ids array<int>")
    left = topology.without_lines(cells, spark.createDataFrame([("s", 2, 1)], "snapshot_id string, v1 int, v2 int"))
    assert [r.polygon_id for r in left.collect()] == [1]


def test_paths_end_within_a_tolerance(spark):
    line = spark.createDataFrame([("s", x, 0) for x in range(2, 9)], "snapshot_id string, x int, y int")
    ends = spark.createDataFrame([("s", 0, 0, 0), ("s", 10, 0, 1)], "snapshot_id string, x int, y int, vertex_id int")
    assert pixels.traced_lines(line, ends).count() == 0
    assert [tuple(r) for r in pixels.traced_lines(line, ends, tolerance=2).collect()] == [("s", 0, 1)]


def test_stored_pairs_are_written_and_read_back(spark, tmp_path):
    points = [(0, 0), (4, 0), (8, 0), (0, 2), (4, 2), (8, 2)]
    doc = {
        "vertices": [{"id": i, "x": x, "y": y} for i, (x, y) in enumerate(points)],
        "polygons": [{"id": 0, "vertexIds": [0, 1, 4, 3]}, {"id": 1, "vertexIds": [1, 2, 5, 4]}],
        "neighborPairs": [{"firstPolygonId": 1, "secondPolygonId": 0}],
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc))
    net, _ = networks.read_networks(spark, str(tmp_path / "in"))
    back = json.loads(sinks.network_json(net).first().json)
    assert back["neighborPairs"] == [{"firstPolygonId": 0, "secondPolygonId": 1}] and not back.get("realDivisions")
