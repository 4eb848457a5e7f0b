import json

from polynet.operators import evaluate
from polynet.sources import networks


def test_stored_pairs_are_no_labels_but_what_is_evaluated(spark, tmp_path):
    points = [(0, 0), (4, 0), (8, 0), (12, 0), (0, 2), (4, 2), (8, 2), (12, 2)]
    doc = {
        "vertices": [{"id": i, "x": x, "y": y} for i, (x, y) in enumerate(points)],
        "lines": [],
        "polygons": [{"id": i, "vertexIds": [i, i + 1, i + 5, i + 4]} for i in range(3)],
    }
    (tmp_path / "plain.json").write_text(json.dumps(doc))
    stored = [{"firstPolygonId": a, "secondPolygonId": b} for a, b in ((1, 0), (0, 1), (0, 2), (2, 9), (1, 1))]
    (tmp_path / "stored.json").write_text(json.dumps(doc | {"neighborPairs": stored}))
    net, _ = networks.read_networks(spark, str(tmp_path))
    assert net.labels.count() == 0 and net.labels.columns == ["snapshot_id", "first_id", "second_id", "division_time"]
    assert {tuple(r) for r in net.pairs.collect()} == {("stored", 0, 1), ("stored", 0, 2)}
    near = sorted(map(tuple, evaluate.universe(net.polygons, net.pairs).collect()))
    assert near == [("plain", 0, 1), ("plain", 1, 2), ("stored", 0, 1), ("stored", 0, 2)]
