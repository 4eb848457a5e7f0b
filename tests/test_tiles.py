import random

import pytest

from polynet.operators import pixels

NEAR = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def plain_components(points, radius):
    label = {p: p for p in points}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for p in points:
        for q in points:
            if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius * radius:
                a, b = root(p), root(q)
                label[max(a, b, key=lambda t: (t[1], t[0]))] = min(a, b, key=lambda t: (t[1], t[0]))
    return {p: root(p) for p in points}


def plain_pruned(points):
    left = set(points)
    while True:
        ends = {p for p in left if sum((p[0] + dx, p[1] + dy) in left for dx, dy in NEAR) == 1}
        if not ends:
            return left
        left -= ends


def frame(spark, by_snapshot, kind="int"):
    return spark.createDataFrame([(s, *p) for s, points in by_snapshot.items() for p in points], f"snapshot_id long, x {kind}, y {kind}")


@pytest.fixture(scope="module")
def scenes():
    rng = random.Random(3)
    noise = {s: {(rng.randrange(-20, 20), rng.randrange(-20, 20)) for _ in range(n)} for s, n in ((1, 120), (2, 300), (3, 700))}
    ring = {(x, y) for x in range(20) for y in range(20) if x in (0, 19) or y in (0, 19)} | {(x, 9) for x in range(20, 60)} | {(30, y) for y in range(10, 40)} | {(x, 40) for x in range(31, 50)}
    odd, even = {(x, 0) for x in range(41)}, {(x, 3) for x in range(40)}
    return noise | {4: ring, 5: odd | even, 6: {(0, 0)}, 7: {(0, 0), (1, 1)}}


@pytest.mark.parametrize("radius", [1.5, 2.0, 3.3])
def test_tiles_connect_what_a_plain_search_connects(spark, scenes, radius):
    got = pixels.connected(frame(spark, scenes), radius, side=7).collect()
    assert len(got) == sum(map(len, scenes.values()))
    want = {s: plain_components(points, radius) for s, points in scenes.items()}
    assert all((r.component.x, r.component.y) == want[r.snapshot_id][r.x, r.y] for r in got)


def test_tiles_connect_points_off_the_grid(spark):
    rng = random.Random(5)
    points = {(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(150)}
    want = plain_components(points, 1.1)
    got = pixels.connected(frame(spark, {1: points}, "double"), 1.1, side=4).collect()
    assert all((r.component.x, r.component.y) == want[r.x, r.y] for r in got) and len(got) == 150


@pytest.mark.parametrize("tile", [6, 256])
def test_spurs_equal_plain_pruning(spark, scenes, tile, monkeypatch):
    monkeypatch.setattr(pixels, "TILE", tile)
    got = {(r.snapshot_id, r.x, r.y) for r in pixels.without_spurs(frame(spark, scenes)).collect()}
    assert got == {(s, *p) for s, points in scenes.items() for p in plain_pruned(points)}


def test_a_spur_of_ten_thousand_pixels_takes_few_rounds(spark, monkeypatch):
    ring = {(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)}
    snake, x, y, step = [], 6, 3, 1  # up and down, two apart, so that it only touches itself along its way
    snake.append((5, 2))
    while len(snake) < 10_000:
        snake.append((x, y))
        if not 0 <= y + step <= 400:
            snake.append((x + 1, y + step))  # a turn by corners, so that no three pixels meet
            x, step = x + 2, -step
        else:
            y += step
    rounds, plain = [], pixels.connected
    monkeypatch.setattr(pixels, "connected", lambda *a: rounds.append(1) or plain(*a))
    got = pixels.without_spurs(frame(spark, {1: ring | set(snake)}))
    assert {(r.x, r.y) for r in got.collect()} == ring | {(5, 2)}  # which closes triangles with the ring
    assert len(rounds) <= 20


def test_tiles_of_an_empty_table(spark):
    empty = frame(spark, {1: [(1, 1)]}).where("x > 1")
    assert pixels.connected(empty, 1.5).isEmpty() and pixels.without_spurs(empty).isEmpty() and pixels.clusters(empty).isEmpty()
