import collections
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from polynet.operators import faces, graph, matching, pixels, places, rules
from polynet.operators.adjacency import neighbours
from polynet.operators.cells import rings
from polynet.plans import catalogue, extraction, ruling  # noqa: F401
from polynet.sources import alldata, networks, sinks
from polynet.sources.mesh import Network
from polynet.streaming import snapshots

from .test_networks import rows_of

SF = "/root/testdata/sf0.001"
TABLES = "nation customer part events".split()
POINT = "snapshot_id string, vertex_id int, x double, y double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", ["rule_list_metrics", "sweep_wide", "cluster_points", "trace_lines", "spur_prune", "faces_from_lines", "otsu_threshold", "nearest_vertex", "points_in_polygons", "polygon_dedup", "polygon_order", "feature_histogram", "temporal_summary", "stored_geometry", "greedy_sweep"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected, got = con.execute(catalogue.ORACLE_SQL[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    both = [df.astype({c: float for c in df.columns if df[c].dtype.kind in "iuf"}).astype(object) for df in (got, expected)]
    both = [df.where(df.notna(), None) for df in both]
    assert rows_of(both[0]) == rows_of(both[1])


def test_components_and_cycles_equal_plain_loops(spark):
    random.seed(1)
    links = [("s", random.randrange(60), random.randrange(60)) for _ in range(40)] + [("t", i, i + 1) for i in range(20)] + [("t", 3, 3)]
    nodes = [(g, i) for g in "st" for i in range(60)]
    want = {n: n[1] for n in nodes}
    for _ in range(60):
        for g, a, b in links:
            low = min(want[g, a], want[g, b])
            want[g, a] = want[g, b] = low
    got = graph.components(frame(spark, nodes, "snapshot_id string, id int"), frame(spark, links, "snapshot_id string, u int, v int"))
    assert {(r.snapshot_id, r.id): r.component for r in got.collect()} == want
    order = list(range(23))
    random.shuffle(order)
    steps = [("s", a, b) for a, b in zip(order[:16], order[1:16] + order[:1])] + [("s", a, b) for a, b in zip(order[16:], order[17:] + order[16:17])]
    following = {a: b for _, a, b in steps}
    place = {}
    for part in (order[:16], order[16:]):
        at = low = min(part)
        for k in range(len(part)):
            place[at], at = (low, k), following[at]
    assert {r.id: (r.cycle, r.place) for r in graph.cycles(frame(spark, steps, "snapshot_id string, id int, next int")).collect()} == place


@pytest.fixture(scope="module")
def grid(spark):
    """Two squares side by side, a spur into the left one, and a lone triangle."""
    at = [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (0.5, 0.5), (5, 5), (6, 5), (5, 6)]
    lines = [(0, 1), (1, 2), (0, 3), (1, 4), (2, 5), (3, 4), (4, 5), (0, 6), (7, 8), (8, 9), (9, 7), (9, 9), (1, 0)]
    points = frame(spark, [("s", i, float(x), float(y)) for i, (x, y) in enumerate(at)], POINT)
    return points, frame(spark, [("s", a, b) for a, b in lines], "snapshot_id string, v1 int, v2 int")


def test_faces(spark, grid):
    got = {r.polygon_id: (r.vertex_ids, r.area) for r in faces.faces(*grid).collect()}
    assert got == {0: ([0, 1, 4, 3, 0, 6], 1.0), 1: ([1, 2, 5, 4], 1.0), 2: ([7, 8, 9], 0.5)}
    assert faces.faces(grid[0], grid[1].limit(0)).count() == 0
    ring = frame(spark, [("s", 9, 7), ("s", 8, 7), ("s", 9, 8), ("u", 0, 1), ("u", 1, 4)], "snapshot_id string, v1 int, v2 int")
    assert [tuple(r) for r in faces.polygons_from_edges(grid[0], ring).collect()] == [("s", [7, 8, 9], 0.5)]
    chosen = frame(spark, [("s", i) for i in (0, 1, 3, 4)], "snapshot_id string, vertex_id int")
    assert [r.vertex_ids for r in faces.polygons_from_vertices(*grid, chosen).collect()] == [[0, 1, 4, 3]]
    loose = frame(spark, [("s", i) for i in (0, 2, 3, 5)], "snapshot_id string, vertex_id int")
    assert [r.vertex_ids for r in faces.polygons_from_vertices(*grid, loose).collect()] == [[0, 2, 5, 3]]


def test_ring_keys(spark):
    rows = frame(spark, [([3, 1, 2],), ([2, 1, 3],), ([1, 2, 3, 1],), ([2, 1, 1],), ([],)], "ids array<int>")
    got = [tuple(r) for r in rows.select(faces.polygon_key(F.col("ids")), faces.cycle_key(F.col("ids"))).collect()]
    assert got == [("1:2:3:", "1:2:3:"), ("1:3:2:", "1:2:3:"), ("1:1:2:3:", "1:2:3:"), ("1:1:2:", "1:1:2:"), ("", "")]


def drawn(spark, picture):
    return frame(spark, [("s", x, y) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "#"], "snapshot_id string, x int, y int")


def test_pixels_of_small_drawings(spark):
    square = drawn(spark, ["        ", " #####  ", " #   #  ", " #   ###", " #####  "])
    left = {(r.x, r.y) for r in pixels.without_spurs(square).collect()}
    assert (7, 3) not in left and (6, 3) in left and len(left) == 15  # (6, 3) touches three pixels of the side
    cross = drawn(spark, ["   #   ", "   #   ", "   #   ", "#######", "   #   ", "   #   ", "   #   "])
    found = pixels.clusters(pixels.junctions(cross, 7, 7)).collect()
    assert len(found) == 5 and {(r.vertex_id, r.vx, r.vy) for r in found} == {(0, 3, 3)}
    assert pixels.clusters(pixels.junctions(cross.limit(0), 7, 7)).count() == 0
    ladder = drawn(spark, ["".join("#" if y in (2, 8) or x in (2, 8) else " " for x in range(11)) for y in range(11)])
    lines = pixels.traced_lines(ladder, pixels.clusters(pixels.junctions(ladder, 11, 11)))
    assert {(r.v1, r.v2) for r in lines.collect()} == {(0, 1), (0, 2), (1, 3), (2, 3)}


def test_otsu_and_binarised(spark):
    random.seed(2)
    values = [random.choice([random.randrange(20, 60), random.randrange(120, 200)]) for _ in range(300)]

    def spread(t):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        return len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2 if low and high else 0

    best = max(sorted(set(values)), key=spread)
    rows = frame(spark, [("s", i, 0, v) for i, v in enumerate(values)] + [("u", 0, 0, None), ("v", 0, 0, 7)], "snapshot_id string, x int, y int, value int")
    assert {r.snapshot_id: r.threshold for r in pixels.otsu(rows, ["snapshot_id"], "value").collect()} == {"s": best, "v": 7}
    assert pixels.binarised(rows).count() == sum(v > best for v in values)
    assert pixels.binarised(rows, 50, invert=True).where("snapshot_id = 's'").count() == sum(v <= 50 for v in values)


def test_places_equal_all_pairs(spark, grid):
    random.seed(3)
    points = [("s", i, random.uniform(-1, 7), random.uniform(-1, 7)) for i in range(200)] + [("s", 900, 1.0, 1.0)]
    df = frame(spark, points, "snapshot_id string, point_id int, x double, y double")
    at = {r.vertex_id: (r.x, r.y) for r in grid[0].collect()}
    want = {}
    for _, i, x, y in points:
        d, v = min(((x - a) ** 2 + (y - b) ** 2, k) for k, (a, b) in at.items())
        if d <= 0.49:
            want[i] = v
    assert {r.point_id: r.vertex_id for r in places.nearest_vertex(df, grid[0], 0.7).collect()} == want
    assert [(r.point_id, r.vertex_id) for r in places.nearest_vertex(df, grid[0], 0).collect()] == [(900, 4)]
    cells = frame(spark, [("s", 0, [0, 1, 4, 3]), ("s", 1, [7, 8, 9])], "snapshot_id string, polygon_id int, vertex_ids array<int>")
    inside = {(i, 0) for _, i, x, y in points if 0 < x < 1 and 0 < y < 1} | {(i, 1) for _, i, x, y in points if x > 5 and y > 5 and x + y < 11}
    assert {(r.point_id, r.polygon_id) for r in places.holding_polygons(df, rings(grid[0], cells), 1.5).collect()} == inside


def test_rule_names_and_errors(spark):
    assert rules.resolve(" Junction-Angle mean ") == rules.resolve("Junction Angle Average") == rules.resolve("junctionangleaveragedegrees") == "junctionAngleAverageDegrees"
    assert rules.resolve("Area Difference") == "areaDiff" and rules.resolve("nothing") is None and rules.resolve(None) is None
    table = frame(spark, [("area diff", 1.0, True, None), ("x", 1.0, True, None), ("areaMin", None, True, None)], "feature string, threshold double, require_above boolean, note string")
    found, errors = rules.rules_of(table)
    assert found == [rules.Rule("areaDiff", 1.0)] and len(errors) == 2


def test_rule_metrics_equal_plain_counts(spark):
    random.seed(4)
    pair = "snapshot_id string, first_id int, second_id int"
    keys = [(s, a, b) for s in "pqr" for a in range(8) for b in range(a + 1, 8) if random.random() < 0.5]
    value = {k: float(random.randrange(100)) for k in keys}
    real = {k for k in keys if k[0] != "r" and random.random() < 0.3}
    gone = {k for k in keys if random.random() < 0.1}
    features = frame(spark, [(*k, v) for k, v in value.items()], f"{pair}, f double")
    some = [rules.Rule("f", 50.0, True, m) for m in (matching.UNCONSTRAINED, matching.GREEDY, matching.GLOBAL)] + [rules.Rule("f", 20.0, False)]
    got = {r.rule_id: r for r in rules.rule_metrics(features, features, frame(spark, sorted(real), pair), some, frame(spark, [(s, b, a) for s, a, b in gone], pair)).collect()}
    for i, rule in enumerate(some):
        passed = {k for k, v in value.items() if (v >= 50 if rule.above else v <= 20)}
        if rule.mode == matching.GREEDY:
            used, kept = set(), set()
            for k in sorted(passed, key=lambda k: (-value[k], k)):
                if not {(k[0], k[1]), (k[0], k[2])} & used:
                    kept.add(k)
                    used |= {(k[0], k[1]), (k[0], k[2])}
            passed = kept
        if rule.mode != matching.GLOBAL:
            est = {k for k in passed - gone if k[0] != "r"}
            assert (got[i].estimated_pairs, got[i].true_positive, got[i].false_negative) == (len(est), len(est & real), len(real - gone - est))
        assert (got[i].files_processed, got[i].real_pairs) == (2, len(real - gone))
        assert got[i].true_positive + got[i].false_positive + got[i].false_negative + got[i].true_negative == got[i].neighbor_pairs


@pytest.fixture(scope="module")
def small(spark, grid):
    cells = frame(spark, [("s", 0, [0, 1, 4, 3]), ("s", 1, [1, 2, 5, 4])], "snapshot_id string, polygon_id int, vertex_ids array<int>")
    labels = frame(spark, [("s", 0, 1, 7)], "snapshot_id string, first_id int, second_id int, division_time int")
    lines = grid[1].where("v1 <> v2").withColumn("line_id", F.col("v1") * 100 + F.col("v2"))
    return Network(grid[0], lines, cells, labels)


def test_sinks_round_trip(spark, small, tmp_path):
    pairs = neighbours(small.polygons).withColumns({"areaRatio": F.lit(0.25), "junctionAngleRatio": F.lit(None).cast("double")}).drop("n_shared")
    table = sinks.estimation_table(pairs, small.labels, pairs)
    assert len(table.columns) == 55
    sinks.write_csv(table, str(tmp_path / "est"), ("filename",))
    back = sinks.read_estimations(spark, str(tmp_path / "est")).collect()
    assert [(r.snapshot_id, r.first_id, r.second_id, r.observed, r.estimated, r.area_ratio, r.junction_angle_ratio) for r in back] == [("s", 0, 1, 1, 1, 0.25, None)]
    row = sinks.pair_geometry_table(pairs, small.labels).first()
    assert (row.pairIndex, row.observed_division, row.division_timing, row.areaRatio, row.junctionAngleRatio) == (1, 1, 7, "0.250000", "N/A")
    text = json.loads(sinks.network_json(small, pairs).first().json)
    assert [p["id"] for p in text["vertices"]] == list(range(10)) and text["estimatedDivisions"] == [{"firstPolygonId": 0, "secondPolygonId": 1}]
    sinks.write_networks(small, str(tmp_path / "nets"))
    file = next((tmp_path / "nets" / "snapshot_id=s").glob("*.txt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.json").write_text(file.read_text())
    again, issues = networks.read_networks(spark, str(tmp_path / "in"))
    assert issues.count() == 0
    for name in ("vertices", "lines", "polygons"):
        columns = sorted(getattr(again, name).columns)
        assert collections.Counter(map(str, getattr(again, name).select(columns).collect())) == collections.Counter(map(str, getattr(small, name).select(columns).collect()))
    assert sinks.feature_catalogue(spark).columns == ["key", "label", "description"]
    with pytest.raises(ValueError):
        sinks.write_csv(small.vertices, str(tmp_path / "bad"))
        sinks.read_estimations(spark, str(tmp_path / "bad"))


def test_stream_of_snapshots(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    text = sinks.network_json(small).first().json
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.json").write_text(text)
        snapshots.write_features(snapshots.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), ("stats",)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.snapshot_id, r.first_id, r.second_id, r.areaRatio) for r in got.collect()) == [("a", 0, 1, 1.0), ("b", 0, 1, 1.0)]


def test_all_data_documents(spark, tmp_path):
    vertices = [{"id": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (2, 0), (2, 1)])]
    doc = {
        "vertices": vertices, "polygons": [{"id": 0, "vertexIds": [0, 1, 2, 3]}, {"id": 1, "vertexIds": [1, 4, 5, 2]}],
        "neighborPairGeometry": {"settings": {"computeAreaRatio": True}, "entries": [
            {"fileName": "a.json", "pairIndex": 1, "firstPolygonId": 1, "secondPolygonId": 0, "observedDivision": True, "divisionTime": 7, "geometry": {"areaRatio": 1.0, "junctionAngleRatio": None}},
            {"firstPolygonId": 1, "secondPolygonId": 1, "geometry": {}}]},
        "estimationRule": {"featureKey": "areaRatio", "threshold": 0.5, "matchingMode": "nonsense"},
        "estimatedDivisions": [{"firstPolygonId": 0, "secondPolygonId": 1}] * 2,
        "realDivisions": [{"firstPolygonId": 1, "secondPolygonId": 0, "time": 7}],
        "performanceMetrics": {"estimatedPairs": 1, "truePositive": 1, "precision": 1.0, "recall": None},
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"vertices": vertices[:1]}))
    data = alldata.read_all_data(spark, str(tmp_path))
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    pair = ["snapshot_id", "first_id", "second_id"]
    assert rows(data.geometry, *pair, "observed_division", "division_time", "areaRatio", "junctionAngleRatio") == [("a", 0, 1, True, 7, 1.0, None)]
    assert rows(data.rules, "snapshot_id", "feature", "threshold", "require_above", "mode") == [("a", "areaRatio", 0.5, True, matching.GLOBAL)]
    assert rows(data.estimated, *pair) == [("a", 0, 1)] and rows(data.network.labels, *pair, "division_time") == [("a", 0, 1, 7)]
    assert rows(data.metrics, "estimated_pairs", "real_pairs", "precision", "recall") == [(1, None, 1.0, None)]
    features = data.geometry.select(*pair, "areaRatio")
    written = alldata.all_data_json(data.network, features, data.estimated, rules.Rule("areaRatio", 0.5, mode=matching.GREEDY), data.metrics)
    parsed = {r.snapshot_id: json.loads(r.json) for r in written.collect()}
    assert set(parsed) == {"a", "b"} and parsed["a"]["neighborPairGeometry"]["entries"][0]["pairIndex"] == 1
    assert parsed["a"]["estimationRule"]["matchingMode"] == "LocalOptimal" and parsed["a"]["realDivisions"] == [{"firstPolygonId": 0, "secondPolygonId": 1, "time": 7}]
    for name, d in parsed.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    again = alldata.read_all_data(spark, str(tmp_path))
    assert rows(again.geometry, *pair, "areaRatio") == [("a", 0, 1, 1.0)] and rows(again.rules, "mode") == [(matching.GREEDY,)] * 2
    assert again.network.polygons.count() == 2 and again.issues.count() == 0
