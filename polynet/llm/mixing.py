"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in a seeded order, cut into
blocks of equal length. The words that a source gives are counted first, then
the blocks that give them are dealt to the output shards by a binary tree: at
each node the block counts of all sources are split between the two halves of
the node's shards by a multivariate-hypergeometric draw, so every shard's
counts are exact and sum to the whole. The blocks of a source are put in a
random order, by ranking a hash of their numbers; a shard draws its blocks
from that order, disjoint from all others', and puts the pieces in a local
random order.

The tree works on one number per source and shard (metadata of the mixture);
everything that touches documents is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, parts, with_before, with_rank

#: Words of a block, and rows that one window is meant to hold.
BLOCK_WORDS, WINDOW_ROWS = 4096, 2000
MIX_SHARDS = 16
#: Sources up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Quota:
    """What one source gives: `words` in all; the draws of blocks that give them; the end of each shard's draws."""

    source: str | None
    size: int
    target: float
    words: int
    shard_ends: tuple[int, ...]


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Words each source should give: `share` of all words by weight, at most `most` times its own.

    Weights repeat along the sources in code point order, null last. What a
    source can't give is dealt to the others by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted, full, out = share * sum(sizes.values()), set(), dict.fromkeys(order, 0.0)
    while len(full) < len(order):
        rest = wanted - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        out |= {s: rest * weight[s] / total for s in order if s not in full}
        above = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not above:
            break
        full |= above
        out |= {s: float(most * sizes[s]) for s in above}
    return out


def split_tree(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source for each shard: exact sums, multivariate-hypergeometric at each node."""
    rng = np.random.default_rng(seed)

    def draw(counts: list[int], n: int) -> list[int]:
        left, rest, need = [], sum(counts), n
        for c in counts:  # the marginal method: one hypergeometric draw a source
            rest -= c
            got = _hypergeometric(rng, c, rest, need)
            left.append(got)
            need -= got
        return left

    def split(counts: list[int], shards: int) -> list[list[int]]:
        if shards == 1:
            return [counts]
        half = shards // 2
        left = draw(counts, sum(counts) * half // shards)
        return split(left, half) + split([c - x for c, x in zip(counts, left, strict=True)], shards - half)

    return split(counts, shards)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` drawn from `good` and `bad` are good, at any size.

    By inversion: ratios of neighbouring chances from the likeliest count
    outwards, as far as twelve standard deviations, beyond which lies less than
    1e-30 of all.
    """
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return high
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 12 * math.isqrt(int(n * good / total * (bad / total) * (total - n) / max(total - 1, 1)) + 1) + 60
    up, down = np.arange(mode, min(high, mode + reach), dtype=float), np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumsum(np.log((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1))))
    fall = np.cumsum(np.log(down / (good - down + 1) * ((bad - n + down) / (n - down + 1))))
    chance = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    return mode - len(fall) + int(np.searchsorted(np.cumsum(chance), rng.random() * chance.sum()).clip(0, len(chance) - 1))


def plan(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float, block: int, shards: int, seed: int) -> list[Quota]:
    goal = targets(sizes, weights, share, most)
    words = {s: min(round(t), math.floor(most * sizes[s])) for s, t in goal.items()}
    by_shard = split_tree([_draws(sizes[s], words[s], block) for s in goal], shards, seed)
    ends = np.cumsum(np.array(by_shard, dtype=object), axis=0).T if goal else []
    return [Quota(s, sizes[s], goal[s], words[s], tuple(map(int, e))) for s, e in zip(goal, ends, strict=True)]


def _draws(size: int, words: int, block: int) -> int:
    """Blocks that give `words` words: whole epochs, then blocks in permuted order, the last one in part."""
    return words // size * parts(size, block) + math.ceil(words % size / block) if size else 0


def _quotas(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, shards: int, block: int, seed: int, window_rows: int) -> tuple[DataFrame, bool]:
    """A row a source with all numbers of its quota, and whether there are few of them."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: int(r["size"]) for r in totals}
    rows = {r["source"]: parts(r["n"], window_rows) for r in totals}
    quotas = plan(sizes, weights, share, most, block, shards, seed)
    kinds = "_source string, _size long, _target double, _words long, _blocks long, _ends array<long>, _slices long"
    table = docs.sparkSession.createDataFrame([(q.source, q.size, q.target, q.words, parts(q.size, block), list(q.shard_ends), rows[q.source]) for q in quotas], kinds)
    return table, len(quotas) <= BROADCAST_SOURCES


def placed_draws(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, shards: int = MIX_SHARDS, block: int = BLOCK_WORDS, seed: int = 0, window_rows: int = WINDOW_ROWS) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each row of `docs` (`row`, a number of its own for each; `doc_id`, `source`, `size`), and the sources' quotas.

    A draw is (`row`, `shard`, `epoch`, `start`, `words`): words
    [start, start + words) of the document. Draws of one epoch are disjoint.
    `docs` is read several times, so it should be a small table of its own.
    Rows of size 0 have no draws; a null source is a source of its own, after
    the others; rows with equal `doc_id` are in the order of `size`, `row`.
    """
    table, few = _quotas(docs, weights, share, most, shards, block, seed, window_rows)
    quota = F.broadcast(table) if few else table
    hashed = docs.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    joined = hashed.join(quota.select("_source", "_slices"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slice_no = F.least(F.floor(((F.col("_hash") / float(1 << 64)) + 0.5) * F.col("_slices")), F.col("_slices") - 1)
    joined = joined.withColumn("_slice", slice_no.cast("long")).select("row", "source", "size", "doc_id", "_hash", "_slice")
    sums = with_before(joined.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")), ["source"], "_slice", "_sum", "_base")
    right = sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_i"), "_base")
    local = F.sum("size").over(Window.partitionBy("source", "_slice").orderBy("_hash", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = joined.withColumn("_at", F.coalesce(local, F.lit(0))).join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_i")))
    placed = placed.where("size > 0").select("row", "source", "size", (F.col("_at") + F.col("_base")).alias("_at"))

    # A piece is what a row has of a block.
    pieces = placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))))
    begin, end = F.greatest(F.col("_block") * block, F.col("_at")), F.least((F.col("_block") + 1) * block, F.col("_at") + F.col("size"))
    pieces = keep(pieces.select("row", "source", "_block", (begin - F.col("_at")).alias("start"), (end - begin).alias("words"), (begin - F.col("_block") * block).alias("_inside")), "pieces")

    # Each block has one piece at its begin. A shorter last block stays last in every epoch.
    blocks = pieces.where("_inside = 0").select("source", "_block").join(quota.select("_source", "_size", "_blocks"), F.col("source").eqNullSafe(F.col("_source")))
    blocks = blocks.withColumn("_last", (F.col("_size") % block != 0) & (F.col("_block") == F.col("_blocks") - 1))
    blocks = blocks.withColumn("_hash", F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("_block")))
    ranked = with_rank(blocks.where("not _last"), ["source"], (F.col("_hash") / float(1 << 64)) + 0.5, [F.col("_hash"), F.col("_block")], F.ceil(F.col("_blocks") / window_rows), "_rank")
    ranks = ranked.select("source", "_block", "_rank").union(blocks.where("_last").select("source", "_block", F.col("_block").alias("_rank")))
    ranks = ranks.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_rank")
    drawn = pieces.join(ranks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")
    drawn = drawn.join(quota, F.col("source").eqNullSafe(F.col("_source"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1)))))

    number, draws = F.col("epoch") * F.col("_blocks") + F.col("_rank"), F.element_at("_ends", -1)
    # words that this draw gives of its block: all, or the rest of the source's words in the last draw
    given = F.when(number < draws - 1, F.lit(block)).when(number < draws, F.col("_words") - F.col("epoch") * F.col("_size") - F.col("_rank") * block).otherwise(F.lit(0))
    taken = F.least(F.col("words"), given - F.col("_inside"))
    shard = F.size(F.filter("_ends", lambda x: x <= number))
    return drawn.where(taken > 0).select("row", shard.alias("shard"), "epoch", "start", taken.alias("words")), quota


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mixture itself: one row of `docs` for each draw, its `text` cut to the words drawn, plus `shard`.

    `docs` needs `doc_id`, `source` and `text`. Whole documents keep their text
    as it is, parts are their words joined by spaces. Rows of a shard come in
    a seeded random order. `n_chars`, if there is such a column, is counted
    anew; a column `shard` of `docs` is replaced; other columns are kept,
    whatever their names. Null and empty texts give nothing; repeated rows are
    documents of their own. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "shard"]
    whole = F.struct(*[F.col(c) for c in names]).alias("doc")
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col("source"), F.col("doc_id"), word_count(F.col("text")).alias("size"), whole), "rows")
    draws, _ = placed_draws(rows.select("row", "doc_id", "source", "size"), seed=seed, **options)
    listed = draws.groupBy("row").agg(F.collect_list(F.struct("shard", "epoch", "start", F.col("words").cast("int").alias("words"))).alias("draws"))
    found = rows.join(listed, "row")
    some = F.exists("draws", lambda d: d["words"] < F.col("size"))
    # the words are found once a document: referred to twice below, they stay a column of their own
    found = found.withColumn("found", F.when(some, F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1))))
    text = lambda d: F.when(F.col("found").isNull() | (d["words"] == F.col("size")), F.col("doc.text")).otherwise(F.array_join(F.slice("found", (d["start"] + 1).cast("int"), d["words"]), " "))
    pieces = found.select("doc", F.col("doc.doc_id").alias("id"), F.explode(F.transform("draws", lambda d: F.struct("row", d["shard"].alias("shard"), d["epoch"].alias("epoch"), d["start"].alias("start"), text(d).alias("text")))).alias("draw"))
    key = F.xxhash64(F.lit(seed + 2), F.col("id").cast("string"), F.col("draw.epoch"), F.col("draw.start"))
    columns = {c: F.col(f"doc.`{c}`") for c in names} | {"text": F.col("draw.text")}
    if "n_chars" in names:
        columns["n_chars"] = F.length("draw.text").cast(docs.schema["n_chars"].dataType)
    pieces = pieces.select(key.alias("_key"), F.col("draw.shard").alias("_shard"), F.struct(*[columns[c].alias(c) for c in names]).alias("doc"))
    pieces = pieces.repartition("_shard", F.pmod(F.col("_key"), F.lit(64))).sortWithinPartitions("_shard", "_key")
    return pieces.select("doc.*", F.col("_shard").alias("shard"))


def mix_documents(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """Digest of the mixture by document: `doc_id`, `size`, `source_size`, `target` (its source's), `taken`, `source`.

    Null and empty texts have size 0; repeated rows are documents of their own;
    other columns are ignored. An empty table gives an empty result.
    """
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    draws, quota = placed_draws(rows, seed=seed, **options)
    took = draws.groupBy("row").agg(F.sum("words").alias("taken"))
    out = rows.join(took, "row", "left").join(quota.select("_source", "_size", "_target"), F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"), "source")
