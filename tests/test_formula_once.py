"""A feature's formula is worked out once a pair, and cells take to their pairs only what it reads."""

import pytest

from polynet.operators import features, matching
from polynet.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rule", ["unconstrained", "sweep"])
def test_a_rule_writes_the_formula_out_once(spark, rule):
    net = catalogue.mesh(spark, SF)
    found = catalogue.estimate_unconstrained(spark, SF) if rule == "unconstrained" else matching.candidates(catalogue._features(net, "junction"), "junctionAngleMaxDegrees", 150.0, above=False)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("atan2(") == 1


def test_cells_take_their_rings_alone_to_pairs(spark, monkeypatch):
    plain, seen = features.with_cells, []
    monkeypatch.setattr(features, "with_cells", lambda pairs, cells: seen.append(cells.columns) or plain(pairs, cells))
    net = catalogue.mesh(spark, SF)
    angles = catalogue._features(net, "junction")
    assert seen == [["snapshot_id", "polygon_id", "ring"]]
    both = catalogue._features(net, "shared_edge", "junction").select(*angles.columns)
    assert sorted(angles.collect()) == sorted(both.collect())


def test_values_that_are_missing_or_not_finite_pass_no_rule(spark):
    rows = [(0, 1, 2, 150.0), (0, 2, 3, None), (0, 3, 4, float("nan")), (0, 4, 5, float("inf")), (0, 5, 6, 145.0), (0, 6, 7, 144.0)]
    table = spark.createDataFrame(rows, "snapshot_id long, first_id int, second_id int, value double")
    assert sorted(map(tuple, matching.candidates(table, "value", 145.0).collect())) == [(0, 1, 2, 150.0, 5.0), (0, 5, 6, 145.0, 0.0)]
    assert sorted(map(tuple, matching.candidates(table, "value", 145.0, above=False).collect())) == [(0, 5, 6, 145.0, 0.0), (0, 6, 7, 144.0, 1.0)]
