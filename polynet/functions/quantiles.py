"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import forget, keep

#: Intervals that a range is cut into at each round, and values of a range that are put in order by one task.
CUTS, FEW = 1024, 10_000


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], few: int = FEW) -> DataFrame:
    """`keys` and `q<percent>` for each of the shares: quantiles of `value`, interpolated between the two nearest values.

    Each order statistic is held by a range of values. A round counts its
    values in `CUTS` intervals and goes on with the one that holds it, until
    few values or equal ones are left: no task sees a group, and rounds grow
    with the logarithm of its spread. Null and not-a-number values don't
    count; infinite ones are not allowed. `rows` is read once a round.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.array(*[F.struct(F.lit(s).alias("share"), f(F.lit(s) * (F.col("_n") - 1)).cast("long").alias("rank"), (F.lit(s) * (F.col("_n") - 1)).alias("at")) for s in shares for f in (F.floor, F.ceil)])
    wanted = keep(whole.withColumn("_r", F.explode(F.array_distinct(ranks))).select(*keys, "_r.share", "_r.rank", "_r.at", "_low", "_high", F.col("_n").alias("_inside"), F.lit(0).cast("long").alias("_below")), "wanted")
    searched = (F.col("_inside") > few) & (F.col("_low") < F.col("_high"))
    own = [*keys, "rank"]
    while not (ranges := wanted.where(searched)).isEmpty():
        ranges = ranges.select(*own, "_low", "_high", "_below").distinct()
        met = rows.join(ranges, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        cut = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * (CUTS - 1))
        counted = met.groupBy(*own, "_below", cut.alias("_cut")).agg(F.count("*").alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_inside").over(Window.partitionBy(*own).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("_below", F.col("_below") + before)
        found = counted.where((F.col("_below") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("_inside"))).select(*own, "_low", "_high", "_inside", "_below")
        old = wanted
        done = wanted.where(~searched)
        wanted = keep(done.unionByName(wanted.where(searched).select(*own, "share", "at").join(found, own)), "wanted")
        forget(old)
    ranges = wanted.select(*own, "_low", "_high", "_below").distinct()
    met = rows.join(ranges.where("_low < _high"), keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("_v")) - 1
    picked = met.withColumn("_place", place).where(F.col("_place") == F.col("rank") - F.col("_below")).select(*own, "_v")
    picked = picked.union(ranges.where("_low = _high").select(*own, F.col("_low").alias("_v")))
    values = wanted.select(*keys, "share", "rank", "at").join(picked, own)
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    each = values.groupBy(*keys, "share").agg((low + (high - low) * (F.first("at") - F.min("rank"))).alias("_q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == s, F.col("_q"))).alias(f"q{round(100 * s)}") for s in shares])
