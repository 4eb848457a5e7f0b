"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors are rotated by matrices learned on a bounded sample (PCA,
then iterative quantisation, from several random starts) and each component's
sign is a bit. Codes are cut into substrings of 8 bits, and each substring has
an index of its own. By the pigeonhole principle, a code within Hamming radius
R of the query's agrees with it up to floor(R / substrings) bits in at least
one substring, so probing all values that near in every index finds all such
codes. What the indexes find is held against the radius, and what lies within
it is reranked by the cosine of the original vectors; nothing else is.

The index is sharded: each shard of bounded size holds the substring indexes
of its own vectors, and blocks of queries probe every shard. Shards are dealt
by a hash of the id, so frequent codes spread over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dimension, keep, parts, uniform, usable

#: Vectors of a shard, queries of a block, vectors that the rotations are learned on, learned rotations.
SHARD_ROWS, QUERY_ROWS, SAMPLE_ROWS, ROTATIONS = 8192, 4096, 10_000, 4
#: Hamming radius, as a share of the bits. Random neighbours at a cosine of 0.45 differ in 0.35 of their bits.
RADIUS = 0.42
#: Pairs of a query and a code that are worked on at once.
PAIRS = 1_000_000


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dim x bits) by iterative quantisation: alternately the nearest signs and the nearest rotation."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def learn_codes(x: np.ndarray, bits: int, rotations: int, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    return [learn_rotation(x, bits, seed=seed + i) for i in range(rotations)]


def encode(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Codes as rows of bytes, one substring each, in whole runs of 8 bytes; spare bits are 0."""
    bits = np.concatenate([(x - mean) @ projection >= 0 for mean, projection in rotations], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)


class ShardIndex:
    """Substring indexes of a shard: for each substring and each value of it, the codes of the shard with that value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.lists = []
        for column in codes.T:
            holds = np.zeros((256, len(codes)), bool)
            holds[column, np.arange(len(codes))] = True
            self.lists.append(np.packbits(holds, axis=1))

    def candidates(self, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, code) numbers of codes within the radius of a query's, some queries at a time.

        A code is looked at only if a probed list of a substring has it.
        """
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= radius // codes.shape[1]
        probed = []
        for lists in self.lists:  # for each value that a query may have, all codes that its probes find
            probed.append(np.stack([np.bitwise_or.reduce(lists[near[v]], axis=0) for v in range(256)]))
        here, asked = self.codes.view(np.uint64), codes.view(np.uint64)
        step = max(1, PAIRS // max(len(self.codes), 1))
        for at in range(0, len(codes), step):
            found = np.zeros((len(codes[at : at + step]), self.lists[0].shape[1]), np.uint8)
            for table, column in zip(probed, codes[at : at + step].T, strict=True):
                found |= table[column]
            q, c = np.nonzero(np.unpackbits(found, axis=1, count=len(self.codes)))
            within = np.bitwise_count(asked[at + q] ^ here[c]).sum(axis=1, dtype=np.uint32) <= radius
            yield at + q[within], c[within]


def nearest(index: ShardIndex, ids: np.ndarray, units: np.ndarray, own: np.ndarray, asked: np.ndarray, codes: np.ndarray, radius: int, k: int) -> pd.DataFrame:
    """`query_id`, `vec_id`, `score` (cosine): each query's `k` best of what the index finds in the shard, ties to the smaller id."""
    out = []
    for q, c in index.candidates(codes, radius):
        other = own[q] != ids[c]
        q, c = q[other], c[other]
        score = np.einsum("ij,ij->i", asked[q], units[c])
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        best = rank < k
        out.append(pd.DataFrame({"query_id": own[q[best]], "vec_id": ids[c[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": own[:0], "vec_id": ids[:0], "score": np.zeros(0)})


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), dim)


def _units(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(most > 0, most, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", radius: float = RADIUS, rotations: int = ROTATIONS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, seed: int = 0) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` (cosine in double precision): each query's `k` nearest found.

    A query is no candidate of its own. Nearest first, ties to the smaller id.
    For queries that have fewer than `k` vectors within the radius, the radius
    is doubled until they have `k` or it spans all bits, so all candidates are
    found if there are fewer than `k`.

    Vectors that are null, zero, hold null or non-finite components, or are not
    of the table's commonest length take no part. Keys are distinct integers.
    Extra columns are ignored. Empty tables give an empty result.
    """
    dim = dimension(vectors, vector)
    rotations = rotations if dim else 1
    bits = max(dim, 1) * rotations

    def cleaned(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col(vector), dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    base = keep(cleaned(vectors), "vectors")
    asked = keep(cleaned(queries), "queries")
    n = base.count()
    sample = base.where(uniform("id", seed=seed) < min(1.0, sample_rows / max(n, 1))).select("vector").toPandas()
    x = _units(_matrix(sample.vector, dim)) if len(sample) > 1 else np.vstack([np.eye(max(dim, 1)), -np.eye(max(dim, 1))])
    learned = learn_codes(x, max(dim, 1), rotations, seed)
    limit, found = int(radius * bits), None
    while True:
        some = keep(_probed(base, asked, learned, dim, limit, k, parts(n, shard_rows), parts(asked.count(), query_rows), seed), "found")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if limit >= bits:
            return best if found is None else found.union(best)
        whole = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        left = keep(asked.join(whole, asked["id"] == whole["query_id"], "left_anti"), "left")
        best = best.join(whole, "query_id", "left_semi")
        found = best if found is None else found.union(best)
        if left.isEmpty():
            return found
        asked, limit = left, min(2 * limit, bits)


def _probed(base: DataFrame, asked: DataFrame, learned: list[tuple[np.ndarray, np.ndarray]], dim: int, limit: int, k: int, shards: int, groups: int, seed: int) -> DataFrame:
    """`query_id`, `vec_id`, `score`: each query's `k` best within the radius `limit` in each shard."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right.id[:0], "vec_id": left.id[:0], "score": np.zeros(0)})
        units, asked_units = _units(_matrix(left.vector, dim)), _units(_matrix(right.vector, dim))
        return nearest(ShardIndex(encode(units, learned)), left.id.to_numpy(), units, right.id.to_numpy(), asked_units, encode(asked_units, learned), limit, k)

    shard = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups)).cast("int")
    everything = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = base.select("id", "vector", shard.alias("shard"), everything(groups).alias("group")).groupBy("shard", "group")
    right = asked.select("id", "vector", group.alias("group"), everything(shards).alias("shard")).groupBy("shard", "group")
    return left.cogroup(right).applyInPandas(run, "query_id long, vec_id long, score double")
