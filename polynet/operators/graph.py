"""Graph loops as joins: connected components, and cycles by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import HOT_SHARE, forget, join_hot, keep, keep_observed


def reachable(links: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """`group`, `id`, `low` (the smallest id reachable) of every id in `links` (`group`, `u`, `v`), but for those that are their own `low`.

    Links are turned, alternately at their larger and smaller ends, into links
    to the smallest neighbour known, so rounds grow with the logarithm of the
    longest chain. Smallest neighbours are aggregated before any shuffle, and
    an end with more than a ten-thousandth of a round's links gets its
    smallest by a broadcast, so neither step gathers a hub's links in a task.

    Self links and null ends are ignored; an empty table gives an empty
    result. Ids may be of any ordered type, structs too.
    """
    key = [*group, "u"]
    turned = lambda df, u, v: df.select(*group, F.col(u).alias("u"), F.col(v).alias("v"))
    ends = links.where("u <> v").select(*group, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, now = keep_observed(ends, "links")
    before = None
    while now != before and now[0]:
        before, limit = now, 2 * now[0] / HOT_SHARE
        both = links.union(turned(links, "v", "u"))
        lowest = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
        large = keep(turned(join_hot(both, lowest, key, limit).where("v > u"), "v", "low").distinct(), "large")
        lowest = large.groupBy(*key).agg(F.min("v").alias("low"), F.count("*").alias("n"))
        small = turned(join_hot(large, lowest, key, limit).where("v <> low"), "v", "low").union(turned(lowest, "u", "low"))
        old = links
        links, now = keep_observed(small.distinct(), "links")
        forget(old, large)
    return links.select(*group, F.col("u").alias("id"), F.col("v").alias("low"))


def components(nodes: DataFrame, links: DataFrame, group: str = "snapshot_id") -> DataFrame:
    """`group`, `id`, `component` (the smallest id reachable by links `u`, `v` of the group) of every node `id`."""
    found = reachable(links, (group,)).withColumnRenamed("low", "component")
    return nodes.select(group, "id").distinct().join(found, [group, "id"], "left").select(group, "id", F.coalesce("component", "id").alias("component"))


def cycles(steps: DataFrame, group: str = "snapshot_id") -> DataFrame:
    """`group`, `id`, `cycle` (smallest id of its cycle), `place` (steps from that one), of a permutation `id` -> `next`.

    Pointer doubling: after round k each id knows the smallest id among the
    2^k that follow it and how far ahead that lies. Once a round changes
    nothing, each id knows its cycle's smallest.
    """
    known = keep(steps.select(group, "id", F.col("next").alias("jump"), F.col("id").alias("low"), F.lit(0).cast("long").alias("ahead")), "cycles")
    span, changed = 1, 1
    while changed:
        there = known.select(group, F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("ahead").alias("_ahead"))
        better, old = F.col("_low") < F.col("low"), known
        known = keep(known.join(there, [group, "jump"]).select(
            group, "id", F.col("_jump").alias("jump"), F.when(better, F.col("_low")).otherwise(F.col("low")).alias("low"),
            F.when(better, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"), better.alias("better"),
        ), "cycles")
        forget(old)
        changed, span = not known.where("better").isEmpty(), 2 * span
    sizes = known.groupBy(group, "low").agg(F.count("*").alias("n"))
    out = known.join(sizes, [group, "low"])
    return out.select(group, "id", F.col("low").alias("cycle"), F.pmod(F.col("n") - F.col("ahead"), F.col("n")).alias("place"))
