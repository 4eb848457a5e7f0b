"""Polygon networks derived from the star-schema tables: a brick wall of six-sided cells for each block of customers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dealt

@dataclass(frozen=True)
class Network:
    """Vertices (snapshot_id, vertex_id, x, y), lines (.., line_id, v1, v2), polygons (.., polygon_id, vertex_ids) labels (.., first_id, second_id, division_time) and, where files may store them, neighbouring pairs (.., first_id, second_id)."""

    vertices: DataFrame
    lines: DataFrame
    polygons: DataFrame
    labels: DataFrame
    pairs: DataFrame | None = None


def _fraction(c: str) -> F.Column:
    return F.col(c).cast("double") - F.floor(c)


def mesh(spark: SparkSession, sf_dir: str) -> Network:
    """A snapshot for each 60 customers: 9 by 13 grid points, moved by customers' balances and parts' prices; 40 cells."""
    customers, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part"))
    snapshots = dealt(customers.select(F.expr("c_custkey div 60").cast("long").alias("snapshot_id")).distinct())
    sizes = customers.agg(F.count("*").alias("n_c")).crossJoin(parts.agg(F.count("*").alias("n_p")))  # one row
    grid = snapshots.select("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(116))).alias("vertex_id")).crossJoin(F.broadcast(sizes))
    grid = grid.withColumn("c_custkey", (131 * F.col("snapshot_id") + F.col("vertex_id")) % F.col("n_c"))
    grid = grid.withColumn("p_partkey", (97 * F.col("snapshot_id") + 7 * F.col("vertex_id")) % F.col("n_p"))
    g, h = F.floor(F.col("vertex_id") / 13), F.col("vertex_id") % 13
    moved = dealt(grid, "c_custkey").join(customers.select("c_custkey", "c_acctbal").hint("merge"), "c_custkey")
    moved = dealt(moved, "p_partkey").join(parts.select("p_partkey", "p_retailprice").hint("merge"), "p_partkey")
    vertices = moved.select("snapshot_id", "vertex_id", (10 * h + 4 * _fraction("c_acctbal") - 2).alias("x"), (10 * g + 4 * _fraction("p_retailprice") - 2).alias("y"))

    polygons = _bricks(snapshots)
    return Network(vertices, _sides(polygons), polygons, labels(polygons))


def customer_mesh(spark: SparkSession, sf_dir: str) -> Network:
    """The same wall for each block of 117 customers, moved by two digits of their balances: snapshots grow with the table.

    Each customer gives one vertex. The last block may be short; its cells that lack a corner are left out.
    """
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    part = lambda v: v - F.floor(v)
    balance, g, h = F.col("c_acctbal").cast("double"), F.floor(F.col("vertex_id") / 13), F.col("vertex_id") % 13
    placed = customers.select(F.expr("c_custkey div 117").cast("long").alias("snapshot_id"), F.expr("c_custkey % 117").cast("int").alias("vertex_id"), "c_acctbal")
    vertices = placed.select("snapshot_id", "vertex_id", (10 * h + 4 * part(balance) - 2).alias("x"), (10 * g + 4 * part(balance / 7) - 2).alias("y"))
    every = _bricks(dealt(vertices.select("snapshot_id").distinct()))
    corners = every.select("snapshot_id", "polygon_id", F.explode("vertex_ids").alias("vertex_id"))
    short = corners.join(vertices.hint("merge"), ["snapshot_id", "vertex_id"], "left_anti").select("snapshot_id", "polygon_id")
    polygons = every.join(short.hint("merge"), ["snapshot_id", "polygon_id"], "left_anti")
    return Network(vertices, _sides(polygons), polygons, labels(polygons))


def _bricks(snapshots: DataFrame) -> DataFrame:
    """40 cells for each `snapshot_id`."""
    cells = snapshots.select("snapshot_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("polygon_id"))
    r, k = F.floor(F.col("polygon_id") / 5).cast("int"), F.col("polygon_id") % 5
    c = r % 2 + 2 * k
    ring = F.array(*[13 * (r + up) + c + along for up, along in ((0, 0), (0, 1), (0, 2), (1, 2), (1, 1), (1, 0))])
    return cells.withColumn("vertex_ids", F.transform(ring, lambda v: v.cast("int")))


def _sides(polygons: DataFrame) -> DataFrame:
    ends = polygons.select("snapshot_id", F.explode(F.transform("vertex_ids", lambda v, i: F.struct(F.least(v, F.get("vertex_ids", (i + 1) % 6)).alias("v1"), F.greatest(v, F.get("vertex_ids", (i + 1) % 6)).alias("v2")))).alias("e"))
    return ends.select("snapshot_id", "e.v1", "e.v2").repartition("snapshot_id", "v1", "v2").distinct().withColumn("line_id", F.col("v1") * 1000 + F.col("v2"))


def labels(polygons: DataFrame) -> DataFrame:
    """Real divisions by a rule on the ids of neighbouring cells."""
    from ..operators.adjacency import neighbours

    near = neighbours(polygons)
    real = near.where((7 * F.col("first_id") + 3 * F.col("second_id") + F.col("snapshot_id")) % 5 == 0)
    return real.select("snapshot_id", "first_id", "second_id", ((F.col("first_id") + F.col("second_id")) % 36 + 1).cast("int").alias("division_time"))
