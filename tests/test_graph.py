import os
import random

from pyspark.sql import functions as F

from polynet.functions import tables
from polynet.operators import graph


def plain(links):
    low = {}
    for pair in links:
        for i in pair:
            low[i] = i
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: m for i, m in low.items() if i != m}


def test_reachable_equals_plain_search(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (7, 7)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    links += [(1000, i) for i in range(1001, 1400)] + [(1399, 1500)]
    frame = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.id: r.low for r in graph.reachable(frame).collect()}
    assert got == plain(links)
    assert graph.reachable(frame.limit(0)).count() == 0


def test_a_hub_meets_no_task_by_its_key(spark):
    """A star of 10,000 leaves: whatever is shuffled by an end alone holds few rows of the hub."""
    links = spark.range(1, 10_001).selectExpr("id as u", "0L as v")
    both = links.union(links.selectExpr("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    joined = tables.join_hot(both, lowest, ["u"], 20_000 / tables.HOT_SHARE)
    assert joined.count() == 20_000
    rest = both.join(lowest.where(f"n > {20_000 / tables.HOT_SHARE}"), "u", "left_anti")
    assert rest.groupBy("u").count().agg({"count": "max"}).first()[0] <= 2
    assert {r.low for r in graph.reachable(links).collect()} == {0}


def test_sums_and_ranks_by_slices(spark):
    rows = [(g, i, (7 * i) % 5) for g in ("a", None) for i in range(0, 9000, 3)]
    frame = spark.createDataFrame(rows, "g string, i long, x long")
    got = {(r.g, r.i): r.b for r in tables.with_before(frame, ["g"], "i", "x", "b").collect()}
    total = {"a": 0, None: 0}
    for g, i, x in rows:
        assert got[g, i] == total[g]
        total[g] += x
    ranked = tables.with_rank(frame, ["g"], F.col("i") / 9000.0, [F.col("i")], F.lit(50), "r").collect()
    assert all(r.r == r.i // 3 for r in ranked) and len(ranked) == len(rows)


def test_kept_tables_can_be_forgotten(spark):
    kept = tables.keep(spark.range(5), "five")
    path = tables._paths[kept].removeprefix("file://")
    assert os.path.isdir(path)
    tables.forget(kept, spark.range(1))
    assert not os.path.isdir(path)
