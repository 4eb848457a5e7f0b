import random

import pytest
from pyspark.sql import functions as F

from polynet.operators import evaluate, rules
from polynet.operators.matching import GREEDY

PAIRS = "snapshot_id long, first_id long, second_id long, value double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    rows = [(s, a, b, rng.choice([*odd, *[float(rng.randrange(-40, 40)) / 4 for _ in range(20)]])) for s in range(3) for a in range(12) for b in range(a + 1, min(a + 4, 12))]
    features = spark.createDataFrame(rows, PAIRS)
    labels = spark.createDataFrame([r[:3] for r in rows if rng.random() < (0.2, 0.9, 0.0)[r[0]]] * 2, "snapshot_id long, first_id long, second_id long")
    return rows, features, labels


@pytest.mark.parametrize("above", [True, False])
def test_sweep_equals_a_count_for_each_threshold(tables, above):
    rows, features, labels = tables
    real = {tuple(r) for r in labels.collect()}
    cuts = [-20.0, -3.25, 0.0, 0.1, 5.0, 5.0, 99.0]
    got = {r.threshold: r for r in evaluate.sweep(features, labels, "value", cuts, above).collect()}
    assert sorted(got) == sorted(set(cuts))
    for t, r in got.items():
        passing = [x[:3] for x in rows if x[3] is not None and abs(x[3]) < float("inf") and (x[3] >= t if above else x[3] <= t)]
        tp = len(real.intersection(passing))
        assert (r.estimated_pairs, r.real_pairs, r.neighbor_pairs, r.true_positive, r.false_positive) == (len(passing), len(real), len(rows), tp, len(passing) - tp)
        assert (r.false_negative, r.true_negative) == (len(real) - tp, len(rows) - len(passing) - len(real) + tp)


def test_ten_thousand_thresholds(tables):
    rows, features, labels = tables
    cuts = [i / 400 - 12.0 for i in range(10_000)]
    got = {r.threshold: r.estimated_pairs for r in evaluate.sweep(features, labels, "value", cuts).collect()}
    assert len(got) == 10_000
    for t in cuts[::997]:
        assert got[t] == sum(1 for x in rows if x[3] is not None and t <= x[3] < float("inf"))


@pytest.mark.parametrize("above", [True, False])
def test_one_greedy_matching_serves_all_thresholds(tables, above):
    _, features, labels = tables
    cuts = [-6.0, -1.5, 0.0, 2.0, 7.25]
    pairs = features.where("snapshot_id < 2 and first_id % 3 > 0").select("snapshot_id", "first_id", "second_id")  # fewer neighbours than false positives
    got = rules.matched_sweep(features, pairs, labels, "value", cuts, GREEDY, above)
    want = rules.rule_metrics(features, pairs, labels, [rules.Rule("value", t, above, GREEDY) for t in cuts]).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sweeps_of_empty_tables(spark):
    features = spark.createDataFrame([], PAIRS)
    labels = features.drop("value")
    got = evaluate.sweep(features, labels, "value", [1.0, 2.0]).orderBy("threshold").collect()
    assert [(r.threshold, r.estimated_pairs, r.neighbor_pairs, r.precision) for r in got] == [(1.0, 0, 0, -1.0), (2.0, 0, 0, -1.0)]
    got = rules.matched_sweep(features, labels, labels, "value", [1.0]).select("estimated_pairs", F.col("true_negative")).collect()
    assert [tuple(r) for r in got] == [(0, 0)]
