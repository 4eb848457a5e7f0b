"""Inferred pairs against labelled ones: categories, counts, ratios, sweeps, comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import quotient
from ..functions.tables import dealt, keep, with_before
from .adjacency import neighbours

PAIR = ["snapshot_id", "first_id", "second_id"]


def universe(polygons: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Pairs to evaluate: a snapshot's stored pairs if it has any, else its neighbouring polygons."""
    near = neighbours(polygons).select(*PAIR)
    if stored is None:
        return near
    return stored.select(*PAIR).distinct().union(near.join(stored.select("snapshot_id").distinct().hint("merge"), "snapshot_id", "left_anti"))


def flagged(pairs: DataFrame, estimated: DataFrame, labels: DataFrame) -> DataFrame:
    """Every neighbouring, inferred or labelled pair with flags `near`, `est`, `real`."""
    flag = lambda df, name: df.select(*PAIR).distinct().withColumn(name, F.lit(True))
    out = flag(pairs, "near").join(flag(dealt(estimated.select(*PAIR), *PAIR), "est").hint("merge"), PAIR, "full").join(flag(labels, "real").hint("merge"), PAIR, "full")
    return out.select(*PAIR, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("near", "est", "real")])


def category(est: Column, real: Column) -> Column:
    return F.when(est & real, "TP").when(est, "FP").when(real, "FN").otherwise("TN")


def counts(flags: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Pairs inferred, labelled and neighbouring, and the confusion counts, by `keys`; `more` aggregates beside them."""
    n = lambda c: F.sum(c.cast("long"))
    est, real, near = F.col("est"), F.col("real"), F.col("near")
    out = flags.groupBy(*keys).agg(
        n(est).alias("estimated_pairs"), n(real).alias("real_pairs"), n(near).alias("neighbor_pairs"),
        n(est & real).alias("true_positive"), n(est & ~real).alias("false_positive"), n(~est & real).alias("false_negative"), *more,
    )
    rest = F.col("neighbor_pairs") - F.col("true_positive") - F.col("false_positive") - F.col("false_negative")
    return out.withColumn("true_negative", F.greatest(F.lit(0), rest).cast("long"))


def restricted_counts(flags: DataFrame, keys: list[str]) -> DataFrame:
    """`counts` over neighbouring pairs alone, and how many inferred and labelled pairs were dropped as they are no neighbours."""
    lost = [F.sum((~F.col("near") & F.col(f"_{c}")).cast("long")).alias(name) for c, name in (("est", "dropped_estimated"), ("real", "dropped_real"))]
    kept = flags.withColumns({"_est": F.col("est"), "_real": F.col("real")}).withColumns({c: F.col(c) & F.col("near") for c in ("est", "real")})
    return counts(kept, keys, *lost)


def skipped(snapshots: DataFrame, polygons: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """`snapshot_id`, `code` of snapshots that are left out: no polygons, fewer than two, or (with `labels`) no labels; the first that holds."""
    n = polygons.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    rows = snapshots.select("snapshot_id").distinct().join(n.hint("merge"), "snapshot_id", "left")
    code = F.when(F.col("n").isNull(), "no_polygons").when(F.col("n") < 2, "fewer_than_two_polygons")
    if labels is not None:
        rows = rows.join(labels.select("snapshot_id").distinct().withColumn("labelled", F.lit(True)).hint("merge"), "snapshot_id", "left")
        code = code.when(F.col("labelled").isNull(), "no_labels")
    return rows.select("snapshot_id", code.alias("code")).where("code is not null")


def with_ratios(table: DataFrame) -> DataFrame:
    """Precision, recall, F1, specificity and accuracy; -1 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    out = table.withColumns({"precision": quotient(tp, tp + fp), "recall": quotient(tp, tp + fn), "specificity": quotient(tn, tn + fp), "accuracy": quotient(tp + tn, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p >= 0) & (r >= 0) & (p + r > 0), 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(-1.0)))


def totals(by_snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed over snapshots, then ratios once."""
    names = [c for c in by_snapshot.columns if c.endswith(("_pairs", "_positive", "_negative"))]
    return with_ratios(by_snapshot.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]))


def passed(value: Column, thresholds: list[float], above: bool = True) -> Column:
    """How many of the distinct thresholds a value passes (they are the lowest ones; for `above` False, the highest); 0 for undefined values.

    Found by bisection in the sorted thresholds.
    """
    from .matching import passes

    cuts = sorted(set(thresholds)) if above else sorted({-t for t in thresholds})
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    own, at = value if above else -value, F.array(*map(F.lit, map(float, cuts)))
    found = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(at, done + step - 1) <= own, done + step).otherwise(done))
    return F.when(passes(value, F.lit(float("-inf"))), found).otherwise(F.lit(0))


def from_threshold_on(rows: DataFrame, level: str, thresholds: list[float], sums: list[str], above: bool = True) -> DataFrame:
    """`threshold` and, for each distinct one, the sums of columns over the rows that pass it, those with a `level` (see `passed`) that reaches it.

    Rows are added up once by level, then levels from the top down by a two-level scan.
    """
    cuts = sorted(set(thresholds), reverse=not above)
    by_level = rows.groupBy(F.col(level).alias("_level")).agg(*[F.sum(c).alias(c) for c in sums])
    known = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(cuts)], "_level int, threshold double")
    every = known.join(by_level, "_level", "left").fillna(0, sums).withColumn("_down", F.lit(len(cuts)) - F.col("_level"))
    every = every.withColumn("_all", F.lit(0))
    for c in sums:
        every = with_before(every, ["_all"], "_down", c, f"_before_{c}").withColumn(f"_with_{c}", F.col(c) + F.col(f"_before_{c}"))
    return every.select("threshold", *[F.col(f"_with_{c}").alias(c) for c in sums])


def sweep(features: DataFrame, labels: DataFrame, feature: str, thresholds: list[float], above: bool = True) -> DataFrame:
    """Metrics of the unconstrained rule at each of the distinct thresholds, features read once, however many thresholds there are."""
    real = labels.select(*PAIR).distinct().withColumn("real", F.lit(1))
    rows = dealt(features.select(*PAIR, F.col(feature).cast("double").alias("value")), *PAIR).join(real.hint("merge"), PAIR, "left").select(F.coalesce("real", F.lit(0)).cast("long").alias("real"), "value")
    rows = rows.groupBy(passed(F.col("value"), thresholds, above).alias("level"), "real").agg(F.count("*").alias("n"))
    rows = keep(rows, "levels")  # at most two for each threshold
    inferred = from_threshold_on(rows.withColumn("tp", F.col("n") * F.col("real")), "level", thresholds, ["n", "tp"], above)
    whole = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("near"), F.coalesce(F.sum(F.col("n") * F.col("real")), F.lit(0)).alias("real"))
    table = inferred.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")  # one row on that side
    n, tp, near, real = (F.col(c) for c in ("n", "tp", "near", "real"))
    return with_ratios(table.select(
        "threshold", n.alias("estimated_pairs"), real.alias("real_pairs"), near.alias("neighbor_pairs"), tp.alias("true_positive"), (n - tp).alias("false_positive"),
        (real - tp).alias("false_negative"), F.greatest(F.lit(0), near - n - real + tp).alias("true_negative"),
    ))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that two results with `observed`, `estimated`, `value` judge differently, as first minus second."""
    key = [*PAIR, "observed"]
    other = second.select(*key, F.col("estimated").alias("_estimated"), F.col("value").alias("_value"))
    joined = dealt(first, *key).join(other.hint("merge"), key).where(F.col("estimated") != F.col("_estimated"))
    return joined.select(*key, (F.col("estimated") - F.col("_estimated")).alias("estimated_division_difference"), (F.col("value") - F.col("_value")).alias("feature_difference"))


def compare_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """As `compare`, for results whose features are columns: a `<feature>_difference` for each feature that both have."""
    key = [*PAIR, "observed"]
    common = [c for c in first.columns if c in second.columns and c not in (*key, "estimated")]
    other = second.select(*key, *[F.col(c).alias(f"_{c}") for c in ("estimated", *common)])
    joined = first.select(*key, "estimated", *common).join(other.hint("merge"), key).where(F.col("estimated") != F.col("_estimated"))
    less = lambda c: F.col(c) - F.col(f"_{c}")
    return joined.select(*key, less("estimated").alias("estimated_division_difference"), *[less(c).alias(f"{c}_difference") for c in common])
