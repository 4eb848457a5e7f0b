"""Which polygons of a snapshot are neighbours, and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import dealt

#: Members of an owner up to which its own pairs of members are listed.
LISTED = 64


def _memberships(members: DataFrame, group: list[str], owner: str, member: str) -> DataFrame:
    """Distinct memberships without nulls."""
    keys = [*group, owner, member]
    return members.select(*keys).dropna(subset=keys).distinct()


def _joined(left: DataFrame, right: DataFrame, group: list[str], owner: str, member: str) -> DataFrame:
    """Pairs of owners, one row for each member that they share."""
    return left.withColumnRenamed(owner, "first_id").join(right.withColumnRenamed(owner, "second_id"), [*group, member])


def _at_least(pairs: DataFrame, group: list[str], k: int) -> DataFrame:
    return pairs.groupBy(*group, "first_id", "second_id").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= k)


def share_k_pairs(members: DataFrame, group: list[str], owner: str, member: str, k: int = 2) -> DataFrame:
    """Pairs of owners in a group that have at least `k` members in common: group, `first_id`, `second_id`, `n_shared`.

    Repeated memberships count once, null groups, owners and members not at
    all. For `k` of 2 and more, owners meet by pairs of members, so each joined
    row belongs to a pair with two members in common, and a member with many
    owners pairs nobody by itself. Owners of more than `LISTED` members would
    have too many pairs; they meet all owners by single members.
    """
    one = _memberships(members, group, owner, member)
    if k < 2:
        return _at_least(_joined(one, one.hint("merge"), group, owner, member).where("first_id < second_id"), group, k)
    large = one.groupBy(*group, owner).count().where(F.col("count") > LISTED).drop("count")
    small = one.join(large, [*group, owner], "left_anti")
    listed = small.groupBy(*group, owner).agg(F.sort_array(F.collect_list(member)).alias("_all"))
    both = lambda x, i: F.transform(F.slice("_all", i + 2, F.size("_all")), lambda y: F.struct(x.alias("one"), y.alias("other")))
    listed = listed.select(*group, owner, F.explode(F.flatten(F.transform("_all", both))).alias("_two")).select(*group, owner, "_two.one", "_two.other")
    met = listed.withColumnRenamed(owner, "first_id").join(listed.withColumnRenamed(owner, "second_id"), [*group, "one", "other"]).where("first_id < second_id")
    near = met.groupBy(*group, "first_id", "second_id").agg(F.count("*").alias("n"))
    # n members make n (n - 1) / 2 pairs.
    near = near.select(*group, "first_id", "second_id", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("n_shared")).where(F.col("n_shared") >= k)

    heavy = one.join(large, [*group, owner], "left_semi")
    among = _joined(heavy, heavy, group, owner, member).where("first_id < second_id")
    across = _joined(heavy, small, group, owner, member).select(*group, F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"))
    return near.unionByName(_at_least(among.select(*group, "first_id", "second_id").union(across), group, k))


def neighbours(polygons: DataFrame, k: int = 2) -> DataFrame:
    """Neighbouring polygons: those that share at least `k` vertices. A vertex has few polygons, so they meet by single vertices.

    Listed vertices are dealt by place before any sum, as one task may have listed those of very many polygons.
    """
    members = dealt(polygons.select("snapshot_id", "polygon_id", F.explode("vertex_ids").alias("vertex_id")), "snapshot_id", "vertex_id")
    one = _memberships(members, ["snapshot_id"], "polygon_id", "vertex_id")
    return _at_least(_joined(one, one.hint("merge"), ["snapshot_id"], "polygon_id", "vertex_id").where("first_id < second_id"), ["snapshot_id"], k)


def relations(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Shared vertices and edges, connecting vertices and the rest of each pair, as sorted arrays."""
    joined = with_cells(pairs, cells)
    ids = lambda side: F.transform(f"{side}.ring", lambda p: p["v"])
    keys = lambda side: F.transform(f"{side}.edges", lambda e: F.struct(F.least(e["v1"], e["v2"]).alias("v1"), F.greatest(e["v1"], e["v2"]).alias("v2")))
    out = joined.withColumn("shared_vertices", F.array_sort(F.array_intersect(ids("a"), ids("b"))))
    out = out.withColumn("shared_edges", F.array_sort(F.array_intersect(keys("a"), keys("b"))))
    every = F.concat(keys("a"), keys("b"))
    inside = lambda v: F.array_contains("shared_vertices", v)
    connecting = F.filter(every, lambda e: inside(e["v1"]) != inside(e["v2"]))
    out = out.withColumn("connecting_vertices", F.array_sort(F.array_distinct(F.transform(connecting, lambda e: F.when(inside(e["v1"]), e["v2"]).otherwise(e["v1"])))))
    others = F.array_except(F.array_except(F.array_union(ids("a"), ids("b")), F.col("shared_vertices")), F.col("connecting_vertices"))
    return out.withColumn("other_vertices", F.array_sort(others)).drop("a", "b")


def with_cells(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Both cells of each pair as structs `a` and `b`; pairs with a missing cell are left out.

    Pairs are dealt for either join, as rows with whole cells take far more memory than the bytes that Spark would put tasks together by.
    """
    whole = cells.select("snapshot_id", F.struct(*[c for c in cells.columns if c != "snapshot_id"]).alias("cell"))
    first = whole.select("snapshot_id", F.col("cell.polygon_id").alias("first_id"), F.col("cell").alias("a"))
    second = whole.select("snapshot_id", F.col("cell.polygon_id").alias("second_id"), F.col("cell").alias("b"))
    with_first = dealt(pairs, "snapshot_id", "first_id").join(first.hint("merge"), ["snapshot_id", "first_id"])
    return dealt(with_first, "snapshot_id", "second_id").join(second.hint("merge"), ["snapshot_id", "second_id"])
