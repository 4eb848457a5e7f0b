"""Tables that outlive lost executors, joins that hot keys don't slow, and sums over ordered slices."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot; there are fewer hot keys than that.
HOT_SHARE = 10_000
#: Slices whose sums one window adds up.
SLICES = 2000

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="polynet-")


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; where it is unset, a folder of our own on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again.

    Cuts lineage in a way that outlives lost executors, and is computed once
    (a reliable `checkpoint()` computes its input twice).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/polynet-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


def keep_observed(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """`keep`, and the table's state: its number of rows and a sum of their hashes, taken while it is written."""
    seen = Observation()
    kept = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("hash")), name)
    return kept, (seen.get["n"], seen.get["hash"])


def forget(*tables: DataFrame) -> None:
    """Delete kept tables that no later step reads; others are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` (none: in turn) to as many tasks as `spark.sql.shuffle.partitions` says, however few bytes it takes.

    Spark puts small partitions of other shuffles together by their bytes, though each row may list many
    and ids that repeat take few bytes: one task may then hold most of a table. Distinct rows are dealt in
    turn, as Spark drops a shuffle by the keys that they were made distinct by.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], limit: float, rows: str = "n") -> DataFrame:
    """`many` inner-joined with `one`, which has each key once and in `rows` how many rows of `many` have it.

    Keys of more than `limit` rows are broadcast, so their rows meet no task
    by their key. `limit` must be at least the rows of `many` over `HOT_SHARE`:
    then fewer than `HOT_SHARE` rows are broadcast, whatever the size of either.
    `many` is read twice.
    """
    hot = F.broadcast(one.where(F.col(rows) > limit))
    here = many.join(hot, keys)
    rest = many.join(F.broadcast(one.where(F.col(rows) > limit).select(*keys)), keys, "left_anti")
    return here.unionByName(rest.join(one.where(F.col(rows) <= limit), keys))


def with_before(sums: DataFrame, groups: list[str], at: str, value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the group with a smaller `at` (whole numbers from 0, each once).

    Runs of `SLICES` rows are added up first, then the sums of the runs, so a
    window holds at most `SLICES` rows of a group, or one row for so many.
    """
    runs = sums.withColumn("_run", F.floor(F.col(at) / SLICES))
    whole = runs.groupBy(*groups, "_run").agg(F.sum(value).alias("_sum"))
    earlier = lambda *by: Window.partitionBy(*groups, *by).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_run_base", F.coalesce(F.sum("_sum").over(earlier().orderBy("_run")), F.lit(0))).drop("_sum")
    right = whole.select(*[F.col(c).alias(f"_r{c}") for c in [*groups, "_run"]], "_run_base")
    on = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in [*groups, "_run"]]
    out = runs.withColumn(name, F.coalesce(F.sum(value).over(earlier("_run").orderBy(at)), F.lit(0))).join(right, on)
    return out.withColumn(name, F.col(name) + F.col("_run_base")).drop(*right.columns, "_run")


def with_rank(df: DataFrame, groups: list[str], at: Column, order: list[Column], windows: Column, name: str) -> DataFrame:
    """Add `name`: the rank from 0 of each row within `groups`, by `at` in [0, 1) and then `order`.

    A group is cut into `windows` slices of `at`; ranks within a slice are
    added to the number of rows in the slices before it, so that a group of any
    size is ranked by many tasks. `order` must begin with what `at` grows with.
    """
    sliced = df.withColumn("_slice", F.least(F.floor(at * windows), windows - 1).cast("long"))
    counts = with_before(sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n")), groups, "_slice", "_n", "_before").drop("_n")
    right = counts.select(*[F.col(c).alias(f"_r{c}") for c in [*groups, "_slice"]], "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in [*groups, "_slice"]]
    local = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(*order)) - 1
    ranked = sliced.withColumn("_local", local).join(right, on)
    return ranked.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_slice", *right.columns)
