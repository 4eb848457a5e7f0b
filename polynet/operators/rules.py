"""Lists of rules: every rule's estimate and metrics in one job."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.tables import dealt, keep
from . import evaluate
from .feature_names import LABELS
from .matching import GLOBAL, GREEDY, UNCONSTRAINED, candidates, match, passes

PAIR = ["snapshot_id", "first_id", "second_id"]
#: Other names of features, normalised. Fixed values.
ALIASES = {
    "junctionanglemean": "junctionAngleAverageDegrees", "junctionangleaverage": "junctionAngleAverageDegrees", "junctionangleavg": "junctionAngleAverageDegrees",
    "junctionanglemin": "junctionAngleMinDegrees", "junctionanglemax": "junctionAngleMaxDegrees", "junctionanglediff": "junctionAngleDifferenceDegrees",
    "junctionangledifference": "junctionAngleDifferenceDegrees", "junctionangleratio": "junctionAngleRatio",
}


@dataclass(frozen=True)
class Rule:
    """Pairs whose `feature` is on one side of `threshold`, matched by `mode` (unknown ones count as `global`)."""

    feature: str
    threshold: float
    above: bool = True
    mode: str = UNCONSTRAINED
    note: str | None = None


def label_of(feature: str) -> str:
    """A feature's published label; a column of the caller's own is its own label."""
    return LABELS.get(feature, feature)


def feature_names() -> list[str]:
    return list(LABELS)


def resolve(name: str | None, known: list[str] | None = None) -> str | None:
    """The feature that a name means, whatever its case, spaces and marks; with "degrees" or "deg" left out too. None if unknown."""
    plain = lambda s: re.sub(r"[^a-z0-9]+", "", (s or "").strip().lower())
    bare = lambda s: re.sub("deg(rees?)?$", "", s)
    wanted = plain(name)
    if wanted in ALIASES:
        return ALIASES[wanted]
    for feature in known or feature_names():
        label = plain(label_of(feature))
        if wanted and (wanted in (plain(feature), label) or bare(wanted) == bare(label)):
            return feature
    return None


def rules_of(table: DataFrame, mode: str = UNCONSTRAINED) -> tuple[list[Rule], list[str]]:
    """Rules of a rule table (a few rows that a person wrote), and what is wrong with the others."""
    return rules_of_lines(table.collect(), mode)


def rules_of_lines(lines: list, mode: str = UNCONSTRAINED) -> tuple[list[Rule], list[str]]:
    """`rules_of` lines that are read already."""
    rules, errors = [], []
    for r in lines:
        feature = resolve(r["feature"])
        if feature is None:
            errors.append(f"unknown feature {r['feature']}")
        elif r["threshold"] is None:
            errors.append(f"invalid cutoff for {r['feature']}")
        else:
            rules.append(Rule(feature, r["threshold"], r["require_above"], mode, r["note"]))
    return rules, errors


def rule_report(metrics: DataFrame, table: DataFrame, skipped: DataFrame | None = None, mode: str = UNCONSTRAINED) -> DataFrame:
    """One row for each line of a rule table: `rule_metrics` of the good ones (in their order), `errors` of the others, with counts of 0 and ratios of -1.

    `feature_key`, `comparison`, `direction` (as written, if the table has it) and `note` are the line's, for bad ones too. `warnings` counts the snapshots left out, by reason (`evaluate.skipped`), so it does not grow with their number.
    """
    lines = table.collect()  # a few that a person wrote
    rows, good = [], 0
    for i, r in enumerate(lines):
        rules, errors = rules_of_lines([r], mode)
        key = resolve(r["feature"])
        said = ">= cutoff" if r["require_above"] else "<= cutoff"
        direction = r["direction"] if "direction" in table.columns else None
        rows.append((i, r["feature"], label_of(key) if key else r["feature"], key, good if rules else None, r["threshold"], said, direction, r["note"], " | ".join(errors)))
        good += len(rules)
    spark = table.sparkSession
    known = spark.createDataFrame(rows, "line int, feature string, label string, feature_key string, rule_id int, threshold double, comparison string, direction string, note string, errors string")
    report = known.join(metrics.drop("threshold", "feature_key", "comparison", "note"), "rule_id", "left").drop("rule_id")
    ratios = ("precision", "recall", "f1", "specificity", "accuracy")
    report = report.fillna(-1.0, list(ratios)).fillna(0, [c for c, t in metrics.dtypes if t == "bigint"])
    if skipped is None:
        return report.withColumn("warnings", F.lit(""))
    reasons = skipped.groupBy("code").agg(F.count("*").alias("n"))
    said = F.concat(F.col("n").cast("string"), F.lit(" snapshots left out: "), F.col("code"))
    warnings = reasons.agg(F.array_join(F.array_sort(F.collect_list(said)), " | ").alias("warnings"))
    # one row on either side of this join
    return report.withColumn("_one", F.lit(1)).join(F.broadcast(warnings.withColumn("_one", F.lit(1))), "_one").drop("_one")


def without(pairs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Pairs that are no exception, whichever way round the exception names its cells."""
    gone = exceptions.select("snapshot_id", F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"))
    return pairs.join(gone.distinct().hint("merge"), PAIR, "left_anti")


def estimates(features: DataFrame, rules: list[Rule], exceptions: DataFrame | None = None) -> DataFrame:
    """`rule_id`, pair, `value`, `score` of the pairs that each rule infers.

    Features are read once for all rules; one that is no column is undefined. Exceptions leave the result after
    matching, so an excepted pair can keep another from being matched.
    """

    def tried(i: int, r: Rule) -> Column:
        value = F.col(r.feature).cast("double") if r.feature in features.columns else F.lit(float("nan"))
        score = value - r.threshold if r.above else r.threshold - value
        mode = r.mode if r.mode in (UNCONSTRAINED, GREEDY) else GLOBAL
        return F.struct(F.lit(i).alias("rule_id"), F.lit(mode).alias("mode"), value.alias("value"), score.alias("score"), passes(value, F.lit(r.threshold), r.above).alias("ok"))

    each = features.select(*PAIR, F.explode(F.array(*[tried(i, r) for i, r in enumerate(rules)])).alias("t")).where("t.ok")
    each = each.select("t.rule_id", *PAIR, "t.value", "t.score", "t.mode")
    out = None
    for mode in sorted({r.mode if r.mode in (UNCONSTRAINED, GREEDY) else GLOBAL for r in rules}):
        part = match(each.where(F.col("mode") == mode).drop("mode"), mode, ("rule_id", "snapshot_id"))
        out = part if out is None else out.union(part)
    return out if exceptions is None else without(out, exceptions)


def rule_metrics(features: DataFrame, pairs: DataFrame, labels: DataFrame, rules: list[Rule], exceptions: DataFrame | None = None) -> DataFrame:
    """One row a rule: what it is, snapshots processed and with results, summed confusion counts, ratios.

    A snapshot without labels is left out. Excepted pairs are neither
    neighbours nor labels, and no estimates after matching.
    """
    near, real = pairs.select(*PAIR).distinct(), labels.select(*PAIR).distinct()
    if exceptions is not None:
        near, real = without(near, exceptions), without(real, exceptions)
    labelled = labels.select("snapshot_id").distinct()
    found = estimates(features, rules, exceptions).join(labelled.hint("merge"), "snapshot_id", "left_semi")
    hit = found.join(real.withColumn("real", F.lit(1)).hint("merge"), PAIR, "left")
    hit = hit.groupBy("rule_id", "snapshot_id").agg(F.count("*").alias("est"), F.count("real").alias("tp"))
    sizes = near.groupBy("snapshot_id").agg(F.count("*").alias("near")).join(labelled.hint("merge"), "snapshot_id", "left_semi")
    sizes = sizes.join(real.groupBy("snapshot_id").agg(F.count("*").alias("real")).hint("merge"), "snapshot_id", "left")
    every = sizes.withColumn("rule_id", F.explode(F.array(*map(F.lit, range(len(rules))))))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = every.join(hit.hint("merge"), ["rule_id", "snapshot_id"], "left").select(
        "rule_id", "snapshot_id", n("est").alias("estimated_pairs"), n("real").alias("real_pairs"), F.col("near").alias("neighbor_pairs"), n("tp").alias("true_positive"),
        (n("est") - n("tp")).alias("false_positive"), (n("real") - n("tp")).alias("false_negative"),
        F.greatest(F.lit(0), F.col("near") - n("est") - n("real") + n("tp")).alias("true_negative"),
    )
    files = counts.groupBy("rule_id").agg(F.count("*").alias("files_processed"), F.sum((F.col("estimated_pairs") > 0).cast("long")).alias("files_with_results"))
    named = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(r.feature).alias("feature_key"), F.lit(float(r.threshold)).alias("threshold"), F.lit(">= cutoff" if r.above else "<= cutoff").alias("comparison"), F.lit(r.note).cast("string").alias("note")) for i, r in enumerate(rules)])
    totals = evaluate.totals(counts, ["rule_id"]).join(files, "rule_id")
    rule = F.get(named, F.col("rule_id"))
    return totals.withColumns({c: rule[c] for c in ("feature_key", "threshold", "comparison", "note")})


def sweep_wide(features: DataFrame, labels: DataFrame, feature: str, thresholds: list[float], above: bool = True) -> DataFrame:
    """One row a pair: `<feature>_value`, `observed_division` and a flag `estimated_division_<t>` for each threshold, unconstrained."""
    rows = features.join(labels.select(*PAIR).distinct().withColumn("_real", F.lit(1)).hint("merge"), PAIR, "left")
    flags = [F.coalesce(passes(F.col(feature), F.lit(t), above), F.lit(False)).cast("int").alias(f"estimated_division_{t:g}") for t in thresholds]
    return rows.select(*PAIR, F.col(feature).alias(f"{feature}_value"), F.coalesce("_real", F.lit(0)).alias("observed_division"), *flags)


def division_positions(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs with both centroids, the point between them, and the angle between them: acute, and folded to 0-180."""
    at = lambda c: cells.select("snapshot_id", F.col("polygon_id").alias(f"{c}_id"), F.col("cx").alias(f"{c}_x"), F.col("cy").alias(f"{c}_y"))
    out = dealt(pairs.select(*PAIR), "snapshot_id", "first_id").join(at("first").hint("merge"), ["snapshot_id", "first_id"])
    out = dealt(out, "snapshot_id", "second_id").join(at("second").hint("merge"), ["snapshot_id", "second_id"])
    dx, dy = F.col("second_x") - F.col("first_x"), F.col("second_y") - F.col("first_y")
    middle = lambda c: (F.col(f"first_{c}") + F.col(f"second_{c}")) / 2
    return out.select(*PAIR, "first_x", "first_y", "second_x", "second_y", middle("x").alias("mid_x"), middle("y").alias("mid_y"), F.degrees(F.atan2(F.abs(dy), F.abs(dx))).alias("acute_angle"), F.degrees(F.abs(F.atan2(dy, dx))).alias("angle_180"))


def feature_summary(features: DataFrame, labels: DataFrame, feature: str) -> DataFrame:
    """Count, mean and quartiles of a feature for labelled and other pairs; undefined values don't count."""
    rows = dealt(features, *PAIR).join(labels.select(*PAIR).distinct().withColumn("real", F.lit(True)).hint("merge"), PAIR, "left")
    value = F.col(feature).cast("double")
    rows = keep(rows.select(F.coalesce("real", F.lit(False)).alias("real"), F.when(~F.isnan(value), value).alias("value")), "values")
    quartiles = quantiles(rows, ["real"], "value", (0.25, 0.5, 0.75))
    return rows.groupBy("real").agg(F.count("value").alias("n"), F.avg("value").alias("mean")).join(quartiles, "real", "left")


def matched_sweep(features: DataFrame, pairs: DataFrame, labels: DataFrame, feature: str, thresholds: list[float], mode: str = GREEDY, above: bool = True) -> DataFrame:
    """Metrics at each threshold with one-to-one matching: `threshold`, counts, ratios.

    Greedy matching takes pairs from the best down, so what it takes at a
    threshold is what it takes at the most lenient one, as far as it passes:
    one matching serves all. Other modes match anew for each threshold, in one job.
    """
    if mode == GREEDY:
        return _greedy_sweep(features, pairs, labels, feature, thresholds, above)
    table = rule_metrics(features, pairs, labels, [Rule(feature, t, above, mode) for t in thresholds])
    return table.drop("rule_id", "feature_key", "comparison", "note", "files_processed", "files_with_results")


def _greedy_sweep(features: DataFrame, pairs: DataFrame, labels: DataFrame, feature: str, thresholds: list[float], above: bool) -> DataFrame:
    near, real = pairs.select(*PAIR).distinct(), labels.select(*PAIR).distinct()
    sizes = near.groupBy("snapshot_id").agg(F.count("*").alias("near")).join(real.groupBy("snapshot_id").agg(F.count("*").alias("real")).hint("merge"), "snapshot_id")
    sizes = keep(sizes, "sizes")
    taken = match(candidates(features, feature, min(thresholds) if above else max(thresholds), above), GREEDY)
    taken = taken.join(real.withColumn("hit", F.lit(1)).hint("merge"), PAIR, "left").join(sizes.hint("merge"), "snapshot_id")
    taken = taken.select("snapshot_id", "score", evaluate.passed(F.col("value"), thresholds, above).alias("level"), F.coalesce("hit", F.lit(0)).cast("long").alias("tp"), F.lit(1).cast("long").alias("n"), (F.col("near") - F.col("real")).alias("others"))
    taken = keep(taken.withColumn("fp", F.col("n") - F.col("tp")), "taken")
    # A snapshot's true negatives don't fall below 0: where it has more false positives than other pairs, only its best ones count.
    over = taken.groupBy("snapshot_id", "others").agg(F.sum("fp").alias("all_fp")).where(F.col("all_fp") > F.greatest("others", F.lit(0))).select("snapshot_id")
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("score")))
    few = taken.where("fp = 1").join(over.hint("merge"), "snapshot_id", "left_semi").withColumn("place", place).where("place <= others").select("level", "fp")
    counted = few.union(taken.join(over.hint("merge"), "snapshot_id", "left_anti").select("level", "fp"))
    rows = taken.select("level", "n", "tp", F.lit(0).cast("long").alias("lost")).union(counted.select("level", F.lit(0).cast("long"), F.lit(0).cast("long"), "fp"))
    inferred = evaluate.from_threshold_on(rows, "level", thresholds, ["n", "tp", "lost"], above)
    whole = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("near", "real")], F.coalesce(F.sum(F.greatest(F.lit(0), F.col("near") - F.col("real"))), F.lit(0)).alias("others"))
    table = inferred.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one")  # one row on that side
    n, tp = F.col("n"), F.col("tp")
    return evaluate.with_ratios(table.select(
        "threshold", n.alias("estimated_pairs"), F.col("real").alias("real_pairs"), F.col("near").alias("neighbor_pairs"), tp.alias("true_positive"), (n - tp).alias("false_positive"),
        (F.col("real") - tp).alias("false_negative"), (F.col("others") - F.col("lost")).alias("true_negative"),
    ))


def feature_histogram(features: DataFrame, labels: DataFrame, feature: str, width: float) -> DataFrame:
    """Pairs by whether they are labelled and by bins of `width`: `real`, `bin` (its lower end), `n`; undefined values don't count."""
    rows = features.where(F.col(feature).isNotNull() & ~F.isnan(feature))
    rows = dealt(rows, *PAIR).join(labels.select(*PAIR).distinct().withColumn("real", F.lit(True)).hint("merge"), PAIR, "left").withColumn("real", F.coalesce("real", F.lit(False)))
    return rows.groupBy("real", (F.floor(F.col(feature) / width) * F.lit(float(width))).alias("bin")).agg(F.count("*").alias("n"))


def temporal_summary(features: DataFrame, labels: DataFrame, feature: str) -> DataFrame:
    """A feature of the labelled pairs by the time of their division (a repeated label's least one): `division_time`, `n`, `mean`, `least`, `most`."""
    rows = features.join(labels.groupBy(*PAIR).agg(F.min("division_time").alias("division_time")).hint("merge"), PAIR)
    return rows.groupBy("division_time").agg(F.count(feature).alias("n"), F.avg(feature).alias("mean"), F.min(feature).alias("least"), F.max(feature).alias("most"))
