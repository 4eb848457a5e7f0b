"""Threshold rules and one-to-one matching of candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, keep, keep_observed
from .graph import components
from .heaviest import heaviest_matching

UNCONSTRAINED, GREEDY, GLOBAL = "unconstrained", "local", "global"


def passes(value: Column, threshold: Column | float, above: Column | bool = True) -> Column:
    """Finite and on the rule's side of the threshold, the threshold included."""
    above = F.lit(above) if isinstance(above, bool) else above
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return finite & F.when(above, value >= threshold).otherwise(value <= threshold)


def candidates(features: DataFrame, feature: str, threshold: float, above: bool = True) -> DataFrame:
    """Pairs that pass a rule, with their `score`: how far past the threshold they are.

    The value goes through an array of one: no filter passes below that, where Spark would write the feature's whole formula out for each use of it.
    """
    value = F.col("value")
    kept = features.select("snapshot_id", "first_id", "second_id", F.explode(F.array(feature)).alias("value")).where(passes(value, F.lit(threshold), above))
    return kept.select("snapshot_id", "first_id", "second_id", "value", F.when(F.lit(above), value - threshold).otherwise(threshold - value).alias("score"))


def greedy_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    used: set = set()
    keep = []
    pdf = pdf.sort_values(["score", "first_id", "second_id"], ascending=[False, True, True], kind="stable")
    for a, b in zip(pdf.first_id, pdf.second_id, strict=True):
        free = a not in used and b not in used
        keep.append(free)
        if free:
            used |= {a, b}
    return pdf[keep]


def _components(pairs: list[tuple[int, int, float]]) -> list[list[int]]:
    """Indexes of pairs by connected component."""
    group: dict[int, int] = {}

    def root(x: int) -> int:
        group.setdefault(x, x)
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for a, b, _ in pairs:
        group[root(a)] = root(b)
    out: dict[int, list[int]] = {}
    for i, (a, _, _) in enumerate(pairs):
        out.setdefault(root(a), []).append(i)
    return list(out.values())


def _heaviest(pairs: list[tuple[int, int, float]]) -> list[int]:
    """Pairs of the matching with the largest sum of scores; among equals, the one that leaves lower cells alone.

    Scores are compared as exact integers, each made smaller by what its pair
    costs in that order of preference, so one matching alone is the heaviest.
    """
    cells = sorted({c for a, b, _ in pairs for c in (a, b)})
    at = {c: i for i, c in enumerate(cells)}
    ratios = [float(s).as_integer_ratio() for _, _, s in pairs]
    scale = max(d for _, d in ratios)  # powers of two
    # What a pair costs is a digit at the place of its lower cell, so all costs together make a number that stays below `unit`.
    digits = [0] * len(cells)
    for a, b, _ in pairs:
        digits[min(at[a], at[b])] += 1
    places, unit = [1] * len(cells), 1
    for u in range(len(cells) - 1, -1, -1):
        places[u], unit = unit, unit * (digits[u] + 1)
    seen = [0] * len(cells)
    edges: dict[tuple[int, int], tuple[int, int]] = {}
    for i, ((a, b, _), (n, d)) in enumerate(zip(pairs, ratios, strict=True)):
        u, v = sorted((at[a], at[b]))
        seen[u] += 1
        weight = n * (scale // d) * unit - seen[u] * places[u]
        if u != v and weight > edges.get((u, v), (0, 0))[0]:
            edges[u, v] = (weight, i)
    mate = heaviest_matching(len(cells), {k: w for k, (w, _) in edges.items()})
    return [edges[u, v][1] for u, v in enumerate(mate) if v > u]


def global_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Maximum-weight matching by component, exact at every size."""
    pdf = pdf.sort_values(["first_id", "second_id"], kind="stable").reset_index(drop=True)
    pairs = list(zip(pdf.first_id.tolist(), pdf.second_id.tolist(), pdf.score.tolist(), strict=True))
    chosen: list[int] = []
    for index in _components(pairs):
        chosen += [index[i] for i in _heaviest([pairs[i] for i in index])]
    return pdf.loc[sorted(chosen)]


#: Pairs of a group up to which it is matched within one task; larger groups are matched by rounds of joins first.
TASK_PAIRS = 50_000


def _ends(pairs: DataFrame) -> DataFrame:
    """A row for each end of a pair: `_group`, `cell`, and the pair as `one`, which sorts best first."""
    one = F.struct((-F.col("score")).alias("least"), "first_id", "second_id", "_pair").alias("one")
    return pairs.select("_group", one, F.explode(F.array_distinct(F.array("first_id", "second_id"))).alias("cell"))


def _best_two(ends: DataFrame) -> DataFrame:
    """`_group`, `cell`, its `best` and `second` best pair (null: none), by two sums before any shuffle."""
    best = ends.groupBy("_group", "cell").agg(F.min("one").alias("best"))
    other = ends.join(best, ["_group", "cell"]).where("one <> best").groupBy("_group", "cell").agg(F.min("one").alias("second"))
    return best.join(other, ["_group", "cell"], "left")


def _with_ranks(pairs: DataFrame) -> DataFrame:
    """Add `a_best`, `a_second`, `b_best`, `b_second`: the best two pairs at each end, and `one`, the pair itself."""
    two = keep(_best_two(_ends(pairs)), "best")
    at = lambda cell, name: two.select("_group", F.col("cell").alias(cell), F.col("best").alias(f"{name}_best"), F.col("second").alias(f"{name}_second"))
    one = F.struct((-F.col("score")).alias("least"), "first_id", "second_id", "_pair")
    return pairs.withColumn("one", one).join(at("first_id", "a"), ["_group", "first_id"]).join(at("second_id", "b"), ["_group", "second_id"])


def _without_cells(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs that share no cell with the chosen ones."""
    gone = chosen.select("_group", F.explode(F.array("first_id", "second_id")).alias("cell")).distinct()
    for end in ("first_id", "second_id"):
        pairs = pairs.join(gone.withColumnRenamed("cell", end), ["_group", end], "left_anti")
    return pairs


def _along_chains(ranked: DataFrame) -> DataFrame:
    """`_group`, `_pair` of pairs that greedy matching chooses: the best at both ends, and those that a chain of single blockers leads to them.

    A pair with one better neighbour alone is chosen just if that one isn't.
    Pointers along such chains are doubled until they end, so a chain of
    falling scores takes rounds that grow with the logarithm of its length.
    """
    is_best = lambda end: F.col("one") == F.col(f"{end}_best")
    is_second = lambda end: F.coalesce(F.col("one") == F.col(f"{end}_second"), F.lit(False))
    first = is_best("a") & is_best("b")
    parent = F.when(is_best("a") & is_second("b"), F.col("b_best._pair")).when(is_best("b") & is_second("a"), F.col("a_best._pair"))
    known = keep(ranked.select("_group", "_pair", first.alias("first"), F.when(first, F.lit(None)).otherwise(parent).alias("up"), F.lit(False).alias("odd")), "chains")
    roots = known.where("first").select("_group", "_pair")
    jumps = keep(known.where("up is not null").select("_group", "_pair", "up", F.lit(True).alias("odd")), "jumps")
    while True:
        further = jumps.select("_group", F.col("_pair").alias("up"), F.col("up").alias("next"), F.col("odd").alias("more"))
        old = jumps
        jumps = keep(jumps.join(further, ["_group", "up"], "left").select("_group", "_pair", F.coalesce("next", "up").alias("up"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")), "jumps")
        forget(old)
        if jumps.where("moved").isEmpty():
            break
    led = jumps.where("not odd").join(roots.withColumnRenamed("_pair", "up"), ["_group", "up"], "left_semi")
    return keep(roots.union(led.select("_group", "_pair")), "chosen")


def greedy_rounds(pairs: DataFrame) -> DataFrame:
    """`_group`, `_pair` of the pairs that greedy matching keeps, of `_group`, `_pair`, `first_id`, `second_id`, `score`.

    Each round takes all pairs that are the best at both their cells, and what
    follows from them along chains, and drops the neighbours of what it took:
    just what taking pairs one by one from the best down gives, without a
    task that sees a whole group.
    """
    live, (n, _) = keep_observed(pairs.select("_group", "_pair", "first_id", "second_id", "score"), "live")
    found = None
    while n:
        chosen = _along_chains(_with_ranks(live))
        found = chosen if found is None else found.union(chosen)
        old = live
        left = _without_cells(live, live.join(chosen, ["_group", "_pair"], "left_semi"))
        live, (n, _) = keep_observed(left, "live")
        forget(old)
    return found if found is not None else pairs.select("_group", "_pair").limit(0)


def certain_rounds(pairs: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Pairs (`_group`, `_pair`) that every heaviest matching holds, and the pairs that are left beside them.

    A pair that weighs more than the best other pairs at its two ends together
    is in all of them, as taking it for these gains; it goes with its
    neighbours. Rounds end when they find less than a hundredth of what is left.
    """
    live, (n, _) = keep_observed(pairs.where("score > 0 and first_id <> second_id"), "live")
    found = None
    while n:
        ranked = _with_ranks(live)
        other = lambda end: F.coalesce(-F.when(F.col("one") == F.col(f"{end}_best"), F.col(f"{end}_second.least")).otherwise(F.col(f"{end}_best.least")), F.lit(0.0))
        sure, (taken, _) = keep_observed(ranked.where(F.col("score") > (other("a") + other("b")) * (1 + 1e-12)).select("_group", "_pair"), "sure")
        if taken:
            found = sure if found is None else found.union(sure)
            old = live
            live, (n, _) = keep_observed(_without_cells(live, live.join(sure, ["_group", "_pair"], "left_semi")), "live")
            forget(old)
        if 100 * taken < n or not taken:
            break
    return found, live


def match(candidates: DataFrame, mode: str = GLOBAL, keys: tuple[str, ...] = ("snapshot_id",), task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Candidates that stay when a cell may be in one pair only; `unconstrained` keeps all.

    A group is a snapshot's candidates under one rule. One of at most
    `task_pairs` is matched within a task. Larger ones are matched by
    `greedy_rounds`; for `global` by `certain_rounds`, then by connected
    component of what is left, found by Spark jobs, each within a task. All
    ways give the same pairs. Score 0 is never chosen by `global`. An unknown
    mode is `global`.
    """
    if mode == UNCONSTRAINED:
        return candidates
    run = greedy_pairs if mode == GREEDY else global_pairs
    names, schema = candidates.columns, candidates.schema
    within = lambda df, *by: df.groupBy(*by).applyInPandas(lambda pdf: run(pdf)[names], schema)
    candidates = keep(candidates, "candidates")
    large = keep(candidates.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > task_pairs).select(F.struct(*keys).alias("_group")), "large")
    if large.isEmpty():
        return within(candidates, *keys)
    grouped = candidates.withColumn("_group", F.struct(*keys))
    small = within(grouped.join(large, "_group", "left_anti").select(*names), *keys)
    many = keep(grouped.join(large, "_group", "left_semi").withColumn("_pair", F.monotonically_increasing_id()), "many")
    by_pair = lambda chosen: many.join(chosen, ["_group", "_pair"], "left_semi").select(*names)
    if mode == GREEDY:
        return small.union(by_pair(greedy_rounds(many)))
    sure, rest = certain_rounds(many)
    links = rest.select("_group", F.col("first_id").alias("u"), F.col("second_id").alias("v"))
    found = components(links.select("_group", F.col("u").alias("id")), links, "_group")
    found = found.select("_group", F.col("id").alias("first_id"), F.col("component").alias("_component"))
    placed = rest.join(found, ["_group", "first_id"]).select(*names, "_component")
    out = small.union(within(placed, *keys, "_component"))
    return out if sure is None else out.union(by_pair(sure))
