"""Settings of all-data documents, the published header of rule-list metrics, and the order of repeated labels."""

import json

import pytest

from polynet.operators import rules
from polynet.operators.feature_names import LABELS, SETTINGS
from polynet.sources import alldata, networks, sinks

POINTS = [{"id": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


def test_every_feature_but_one_has_a_setting():
    governed = [key for keys in SETTINGS.values() for key in keys]
    assert len(SETTINGS) == 29 and len(set(governed)) == len(governed)
    assert set(LABELS) - set(governed) == {"sharedEdgeLength"}
    assert SETTINGS["computeAspectRatioStats"] == ("aspectMean", "aspectMin", "aspectMax", "aspectDiff")


def test_settings_are_read_and_written(spark, tmp_path):
    flags = {"computeAreaRatio": False, "computeCentroidDistance": False, "computeUnheardOf": False}
    docs = {
        "a": {"vertices": POINTS, "neighborPairGeometry": {"settings": flags, "entries": []}, "estimationRule": {"featureKey": "areaRatio", "threshold": 0.5, "geometrySettings": {"computeJunctionAngleMax": False}}},
        "b": {"vertices": POINTS, "neighborPairGeometry": {"settings": {}, "entries": []}},
        "c": {"vertices": POINTS},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    data = alldata.read_all_data(spark, str(tmp_path))
    off = sorted((r.snapshot_id, r.section, r.feature) for r in data.settings.where("not computed").collect())
    assert off == [("a", "geometry", "areaRatio"), ("a", "geometry", "centroidDistance"), ("a", "geometry", "centroidDistanceNormalized"), ("a", "rule", "junctionAngleMaxDegrees")]
    assert data.settings.count() == 2 * (len(LABELS) - 1)

    features = spark.createDataFrame([("a", 0, 1, 0.5, 1.0)], "snapshot_id string, first_id int, second_id int, areaRatio double, areaMin double")
    net = networks.read_networks(spark, str(tmp_path))[0]
    written = alldata.all_data_json(net, features, features, rules.Rule("areaRatio", 0.5), data.metrics).where("snapshot_id = 'a'").first()
    parsed = json.loads(written.json)
    for found in (parsed["neighborPairGeometry"]["settings"], parsed["estimationRule"]["geometrySettings"]):
        assert {s for s, on in found.items() if on} == {"computeAreaRatio", "computeAreaStats"} and set(found) == set(SETTINGS)


def test_published_header_of_rule_metrics(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("feature,cutoff_value,below_or_above,direction,note\nArea Ratio,0.5,above,towards one,a\njunction angle max,soon,above,,b\nno such thing,1,below,,\n")
    table = networks.read_rules(spark, str(tmp_path / "rules.csv"), direction=True)
    features = spark.createDataFrame([("s", 0, 1, 0.75), ("s", 1, 2, 0.25)], "snapshot_id string, first_id int, second_id int, areaRatio double")
    labels = spark.createDataFrame([("s", 0, 1)], "snapshot_id string, first_id int, second_id int")
    good, errors = rules.rules_of(table)
    assert len(good) == 1 and len(errors) == 2
    out = sinks.rule_metrics_table(rules.rule_report(rules.rule_metrics(features, features, labels, good), table))
    assert tuple(out.columns) == (*sinks.RULE_METRICS, "line") and len(sinks.RULE_METRICS) == 21
    first, cutoff, unknown = out.orderBy("line").collect()
    assert tuple(first)[:12] == ("Area Ratio (smaller/bigger)", "areaRatio", "0.500000", ">= cutoff", 1, 1, 1, 1, 1, 0, 0, 1)
    assert tuple(first)[12:21] == (*["1.000000"] * 5, "towards one", "a", "", "")
    assert (cutoff.feature_key, cutoff.threshold, cutoff.precision, cutoff.estimated_pairs, cutoff.note) == ("junctionAngleMaxDegrees", "", "N/A", 0, "b")
    assert (unknown.feature, unknown.feature_key, unknown.threshold, unknown.comparison, unknown.errors) == ("no such thing", "", "1.000000", "<= cutoff", "unknown feature no such thing")


@pytest.mark.parametrize(("repeats", "time"), [("first", "9"), ("last", "2")])
def test_order_of_repeated_labels(spark, repeats, time):
    rows = spark.createDataFrame([("s", 0, 1, 2, 1), ("s", 0, 1, 9, 0)], "snapshot_id string, first_id int, second_id int, division_time int, line int")
    features = spark.createDataFrame([("s", 0, 1, 0.5)], "snapshot_id string, first_id int, second_id int, areaRatio double")
    for table in (sinks.pair_geometry_table(features, rows, repeats), sinks.estimation_table(features, rows, features, repeats)):
        assert [str(r.division_timing) for r in table.collect()] == [time]
    with pytest.raises(ValueError):
        sinks.pair_geometry_table(features, rows, "some")
