"""Sharding: proportional stratified interleaving, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, parts, with_rank

#: Rows that one window of the ranking is meant to hold, and sources up to which their counts are broadcast.
WINDOW_ROWS, BROADCAST_SOURCES = 2000, 10_000


def interleave(rows: DataFrame, key: str, source: str, shards: int, seed: int = 0, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add `shard` and `slot`: every shard holds each source in its share of the whole.

    Rows of a source are shuffled by a seeded hash of `key` and ranked; the
    row of rank r among n has the fractional rank (r + 1/2) / n; all rows in
    the order of fractional ranks are cut into `shards` runs whose counts
    differ by at most one. Slots are gapless from 0 in each shard.

    A null source is a source of its own. Rows with equal keys get adjacent
    ranks, ordered by their other columns; rows that agree in every column
    are interchangeable. Fewer rows than shards leave the last shards empty.
    Columns beginning with `_` are used inside and must not be in `rows`.
    """
    others = [F.col(c) for c in rows.columns if c not in (key, source)]
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    by_source = keep(rows.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_rows")), "sources")
    sources, total = by_source.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    counted = hashed.join(F.broadcast(by_source) if sources <= BROADCAST_SOURCES else by_source, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    at = (F.col("_hash") / float(1 << 64)) + 0.5
    ranked = with_rank(counted, [source], at, [F.col("_hash"), F.col(key), *others], F.ceil(F.col("_rows") / window_rows), "_rank")
    ranked = ranked.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_rows"))
    order = [F.col("_at"), F.col(source), F.col("_hash"), F.col(key), *others]
    placed = with_rank(ranked, [], F.col("_at"), order, F.lit(parts(total, window_rows)), "_place")
    shard = F.floor(F.col("_place") * shards / F.lit(max(total, 1)).cast("long"))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards).cast("double"))
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", (F.col("_place") - first).cast("long")).drop("_hash", "_rows", "_rank", "_at", "_place")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Digest of `interleave` over documents: sizes, checksums and places, without the texts.

    A null text counts as no bytes: size 8, checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = keep(rows, "sizes")
    placed = interleave(rows, "doc_id", "source", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
