import random

import pytest

from polynet.operators import pixels


def plain(values):
    best, found = -1.0, None
    for t in sorted(set(values)):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        score = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2 if high else 0.0
        if score > best * (1 + 1e-12):
            best, found = score, t
    return found


@pytest.mark.parametrize("slices", [2, 7, 256])
def test_slices_give_the_plain_threshold(spark, slices):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(200)] + [rng.gauss(6, 2) for _ in range(90)], "b": [2.5] * 9, "c": [float(rng.randrange(4)) for _ in range(50)], None: [rng.random() ** 9 for _ in range(120)]}
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs] + [("a", None, 1), ("d", None, 1)]
    got = {r.k: r.threshold for r in pixels.otsu(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", slices).collect()}
    assert got == {k: plain(vs) for k, vs in groups.items()}


def test_empty_table(spark):
    assert pixels.otsu(spark.createDataFrame([], "k string, v double"), ["k"], "v").isEmpty()
