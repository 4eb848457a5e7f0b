import itertools
import random

import pandas as pd
import pytest

from polynet.operators import matching


def heaviest_weight(cells, pairs):
    """By the masks of later cells that are taken; cells come in the order of a narrow wall, so masks are few."""
    best = {0: 0}
    for c in range(cells):
        after = {}
        for taken, weight in best.items():
            free, rest = not taken >> c & 1, taken & ~(1 << c)
            options = [(rest, weight)] + [(rest | 1 << b, weight + s) for a, b, s in pairs if free and a == c and not taken >> b & 1]
            for mask, total in options:
                after[mask] = max(after.get(mask, 0), total)
        best = after
    return best[0]


def wall(cells, width=5):
    return [(i, j) for i, j in itertools.combinations(range(cells), 2) if j - i in (width, width + 1) or (j == i + 1 and j % width)]


@pytest.mark.parametrize("cells", [25, 30, 40, 63, 80])
def test_matching_of_one_large_component_is_heaviest(cells):
    rng = random.Random(cells)
    better = 0
    for most in (3, 1000):
        pairs = [(a, b, float(rng.randrange(1, most + 1))) for a, b in wall(cells)]
        pdf = pd.DataFrame([(0, *p) for p in pairs], columns=["snapshot_id", "first_id", "second_id", "score"])
        got, greedy = matching.global_pairs(pdf), matching.greedy_pairs(pdf)
        ends = got.first_id.tolist() + got.second_id.tolist()
        assert len(ends) == len(set(ends))
        assert got.score.sum() == heaviest_weight(cells, pairs)
        better += got.score.sum() > greedy.score.sum()
    assert better


def test_ties_leave_lower_cells_alone():
    pdf = pd.DataFrame([(0, i, (i + 1) % 27, 1.0) for i in range(27)], columns=["snapshot_id", "first_id", "second_id", "score"])
    pdf[["first_id", "second_id"]] = pdf[["first_id", "second_id"]].apply(sorted, axis=1, result_type="expand")
    got = matching.global_pairs(pdf)
    assert list(zip(got.first_id, got.second_id)) == [(i, i + 1) for i in range(1, 27, 2)]


@pytest.mark.parametrize("mode", [matching.GREEDY, matching.GLOBAL])
def test_match_groups_by_component(spark, mode):
    rng = random.Random(4)
    rows = [(s, a + 100 * part, b + 100 * part, float(rng.randrange(1, 50))) for s in ("x", "y", None) for part in (0, 1) for a, b in wall(30)]
    pdf = pd.DataFrame(rows, columns=["snapshot_id", "first_id", "second_id", "score"])
    run = matching.greedy_pairs if mode == matching.GREEDY else matching.global_pairs
    want = pd.concat([run(g) for _, g in pdf.groupby("snapshot_id", dropna=False)])
    frame = spark.createDataFrame(rows, "snapshot_id string, first_id long, second_id long, score double")
    got = matching.match(frame, mode)
    assert got.columns == list(pdf.columns)
    key = lambda r: (str(r[0] or None), *r[1:])
    assert sorted(map(key, map(tuple, got.collect()))) == sorted((str(s) if isinstance(s, str) else "None", a, b, x) for s, a, b, x in want.itertuples(index=False, name=None))


def odd_wall(rng, cells, most):
    return [(a, b, float(rng.randrange(0, most + 1))) for a, b in wall(cells) if rng.random() < 0.9]


@pytest.mark.parametrize("mode", [matching.GREEDY, matching.GLOBAL])
def test_rounds_give_the_same_pairs_as_one_task(spark, mode):
    rng = random.Random(8)
    rows = [(s, *p) for s, most in (("x", 3), ("y", 1000), (None, 50)) for p in odd_wall(rng, 90, most)] + [("z", 1, 2, 5.0), ("z", 3, 3, 4.0)]
    frame = spark.createDataFrame(rows, "snapshot_id string, first_id long, second_id long, score double")
    want, got = (sorted(map(str, matching.match(frame, mode, task_pairs=n).collect())) for n in (1000, 5))
    assert got == want and len(want) > 90


def test_a_chain_of_falling_scores_takes_few_rounds(spark, monkeypatch):
    n = 3000
    frame = spark.createDataFrame([("x", i, i + 1, float(n - i)) for i in range(n)], "snapshot_id string, first_id long, second_id long, score double")
    rounds, plain = [], matching._along_chains
    monkeypatch.setattr(matching, "_along_chains", lambda ranked: rounds.append(1) or plain(ranked))
    got = matching.match(frame, matching.GREEDY, task_pairs=10)
    assert sorted(r.first_id for r in got.collect()) == list(range(0, n, 2))
    assert len(rounds) <= 2


def test_greedy_rounds_equal_greedy_on_a_hundred_thousand_cells_of_one_component(spark):
    rng = random.Random(12)
    width = 316
    pairs = [(c, c + d, rng.random()) for c in range(width * width) for d in ((1,) if c % width < width - 1 else ()) + ((width,) if c < width * (width - 1) else ())]
    pdf = pd.DataFrame([(0, *p) for p in pairs], columns=["snapshot_id", "first_id", "second_id", "score"])
    want = matching.greedy_pairs(pdf)
    got = matching.match(spark.createDataFrame(pdf), matching.GREEDY, task_pairs=1000).toPandas()
    assert sorted(zip(got.first_id, got.second_id)) == sorted(zip(want.first_id, want.second_id))


def test_heaviest_matching_equals_brute_force_on_small_graphs():
    rng = random.Random(2)
    for _ in range(400):
        n, most = rng.randrange(1, 10), rng.choice([1, 3, 1000])
        weights = {(a, b): rng.randrange(1, most + 1) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        mate = matching.heaviest_matching(n, weights)
        assert all(mate[mate[i]] == i for i in range(n) if mate[i] >= 0)
        best = {0: 0}
        for (a, b), w in weights.items():
            for taken, total in list(best.items()):
                if not taken >> a & 1 and not taken >> b & 1:
                    key = taken | 1 << a | 1 << b
                    best[key] = max(best.get(key, 0), total + w)
        assert sum(weights[i, j] for i, j in enumerate(mate) if j > i) == max(best.values())


def test_ten_thousand_cells_of_one_component():
    rng = random.Random(5)
    k = 100
    pairs = [(c, c + d, rng.random()) for c in range(k * k) for d in ((1,) if c % k < k - 1 else ()) + ((k,) if c < k * (k - 1) else ())]
    pdf = pd.DataFrame([(0, *p) for p in pairs], columns=["snapshot_id", "first_id", "second_id", "score"])
    got = matching.global_pairs(pdf)
    ends = got.first_id.tolist() + got.second_id.tolist()
    assert len(ends) == len(set(ends)) and got.score.sum() > matching.greedy_pairs(pdf).score.sum()
