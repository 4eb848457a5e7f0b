"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard on full shingle sets.

Coordinate k of a signature is the smallest pi(sigma(x) + k * step) over the
shingle hashes x of a document: one permutation sigma scatters the hashes over
the ring of 2^64, and one permutation pi, shifted circularly by k, gives all
coordinates. Both are bijections of 64-bit integers.

Steps, each a table in the shared folder:
 1. sketch every document: set size, a print of its whole set, band hashes;
 2. make one class of documents with equal sets;
 3. compare each class with the first class of each of its buckets, on full sets;
 4. in buckets that still hold several components, compare all members in
    blocks of bounded size, on full sets, without listing pairs;
 5. connected components of the confirmed links.

Joins by bucket or class are between kept tables, so Spark can split the
partitions of hot ones; a first class's set has one copy for every `STARS`
classes that are compared with it. Texts are shingled again only if their id may
be in a bucket with another: a bitmap of bounded size says so, which may let
others through but loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reachable
from .common import HOT_SHARE, blocks, forget, join_hot, keep, keep_observed

WORDS, BANDS, ROWS = 5, 22, 6
#: Bits of the bitmap of ids.
SLOTS = 1 << 27
#: Members of one block in step 4, comparisons with one copy of a set in step 3, and bytes of text that are worked on at once.
BLOCK, STARS, BATCH_BYTES = 128, 128, 400_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column, null as empty."""
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text, and the number of words of each text. A-Z counts as a-z."""
    n = len(offsets) - 1
    base = offsets[0]
    data = _LOWER[data[base : offsets[-1]]]
    offsets = offsets - base
    inside = ~_SPACE[data]
    starts = inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[edges] |= inside[edges]
    at = np.flatnonzero(starts)
    per_text = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    if not len(at):
        return np.zeros(0, np.uint64), per_text
    number = np.cumsum(starts) - 1
    place = np.arange(len(data)) - at[np.maximum(number, 0)]
    longest = int(place[inside].max()) + 1
    letters = (data.astype(np.uint64) + np.uint64(1)) * _powers(max(longest, 1))[np.minimum(place, longest - 1).clip(0)]
    letters[~inside] = 0
    return _mix(np.add.reduceat(letters, at)), per_text


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words make one shingle, no words none."""
    each, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    windows = np.zeros(max(len(each) - words + 1, 0), np.uint64)
    for i in range(words):
        windows = windows * _M3 + each[i : i + len(windows)]
    windows = _mix(windows)
    out = []
    for end, n in zip(ends, counts, strict=True):
        if n >= words:
            out.append(np.unique(windows[end - n : end - words + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for i in range(end - n, end):
                short = short * _M3 + each[i : i + 1]
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: `size` coordinates for each nonempty set (rows of empty sets are 0)."""
    out = np.zeros((len(sets), size), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sigma = _mix(np.concatenate([sets[i] for i in full]) + _M3)
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    y, z = np.empty_like(sigma), np.empty_like(sigma)
    with np.errstate(over="ignore"):
        for k in range(size):
            np.add(sigma, np.uint64(k) * _M3, out=y)
            np.right_shift(y, np.uint64(32), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _M2, out=y)
            np.right_shift(y, np.uint64(29), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _M1, out=y)
            out[full, k] = np.minimum.reduceat(y, starts)
    return out


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """128 bits of each whole set."""
    return [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]


def _sliced(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(batch.column(text))
    for a, b in blocks(np.diff(offsets), BATCH_BYTES):
        yield a, b, data, offsets[a : b + 1]


def sketches(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """`id`, `n_shingles`, `print1`, `print2` (of the whole set) and `bands` (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _sliced(batch, "text"):
                sets = shingle_hashes(data, offsets, words)
                signed = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
                of_band = np.zeros((len(sets), bands), np.uint64)
                for i in range(rows):
                    of_band = _mix(of_band * _M3 + signed[:, :, i])
                prints = _prints(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([x if len(s) else x[:0] for x, s in zip(of_band.view(np.int64), sets, strict=True)], pa.list_(pa.int64())),
                ], ["id", "n_shingles", "print1", "print2", "bands"])

    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "id long, n_shingles int, print1 long, print2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """`id`, `print1`, `shingles` (sorted distinct hashes as 8-byte little-endian integers) of `id`, `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _sliced(batch, "text"):
                sets = shingle_hashes(data, offsets, words)
                first = pa.array([p[0] for p in _prints(sets)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), first, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["id", "print1", "shingles"])

    return docs.mapInArrow(run, "id long, print1 long, shingles binary")


def _may_be_in(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of `docs` whose `id` has its bit set in a bitmap of `ids`: all that are among them, and others: few, as long as `n` ids are few beside `SLOTS`.

    The bitmap has eight bits for each id, but `SLOTS` at most.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(min(SLOTS, 1 << max(15, (8 * n).bit_length())))).alias("slot")
    bits = ids.select(slot).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    placed = docs.withColumn("slot", slot).withColumn("bucket", F.expr("bitmap_bucket_number(slot)")).join(F.broadcast(bits), "bucket")  # 4 KB for each 32,768 bits
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)), 16, 10) as int)"
    return placed.where(f"shiftright({byte}, cast(bitmap_bit_position(slot) % 8 as int)) % 2 = 1").select(docs.columns)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of `a`, `b`, `set_a`, `set_b`, the pairs whose sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf.set_a, pdf.set_b, strict=True):
                s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def block_links(ids: np.ndarray, sets: list[np.ndarray], component: np.ndarray, percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Links (member, member) that join the components of a block as far as its similar pairs do.

    Intersection sizes come from products of the incidence matrix of shared
    shingles, `columns` at a time.
    """
    order = np.argsort(ids, kind="stable")
    ids, sets, component = ids[order], [sets[i] for i in order], component[order]
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    rank = np.full(len(counts), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    column, owner = rank[column][rank[column] >= 0], owner[rank[column] >= 0]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(shared), columns):
        here = (column >= at) & (column < at + columns)
        m = np.zeros((len(sets), min(columns, len(shared) - at)), np.float32)
        m[owner[here], column[here] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= component[:, None] != component[None, :]
    out: list[tuple[int, int]] = []
    group = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            group[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """Links between components, of `bucket`, `first`, `second`, `id`, `component`, `shingles`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            last = pdf.iloc[-1]
            same = (pdf.bucket == last.bucket) & (pdf["first"] == last["first"]) & (pdf.second == last.second)
            rest = pdf[same]
            yield links(pdf[~same])
        if rest is not None:
            yield links(rest)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["bucket", "first", "second"], sort=False):
            out += block_links(g.id.to_numpy(), [np.frombuffer(s, "<u8") for s in g.shingles], g.component.to_numpy(), percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    key = ["bucket", "first", "second"]
    return members.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`key`, `n_shingles`, `component_id`, `kept` for each document.

    Two documents are linked if they share a band of their signatures and
    100 * intersection >= percent * union holds for their full shingle sets; a
    component is what links reach, named by its smallest key. At a similarity
    of 0.85 the bands miss one pair in ten thousand; documents with equal sets
    are never missed.

    Null, empty and blank texts have no shingles and stand alone. Rows that
    repeat a key are one document, linked by each of their texts; each row is
    returned, with the size of its own set. Keys are integers; a null key
    stands alone. Extra columns are ignored. An empty table gives an empty result.
    """
    sketch, (all_rows, _) = keep_observed(sketches(docs, key, text, words, bands, rows), "sketches")
    prints = ["n_shingles", "print1", "print2"]
    classes = sketch.where("n_shingles > 0 and id is not null").groupBy(*prints).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes, (n_classes, _) = keep_observed(classes, "classes")
    band_limit = n_classes * bands / HOT_SHARE

    # `rep` and `print1` name a class: texts of one key have several.
    inside = classes.select("rep", "print1", F.posexplode("bands").alias("band", "hash"))
    one = F.struct("rep", "print1")
    buckets = inside.groupBy("band", "hash").agg(F.min(one).alias("pivot"), F.count("*").alias("n"), F.sum(F.xxhash64("rep", "print1").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    buckets = keep(buckets, "buckets")
    members, (n_members, _) = keep_observed(join_hot(inside, buckets, ["band", "hash"], band_limit).select("rep", "print1", "pivot", "n", "sum", "band", "hash"), "members")
    texts = _may_be_in(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), members.select(F.col("rep").alias("id")), n_members)
    sets = keep(shingle_sets(texts, words).dropDuplicates(["id", "print1"]), "sets")
    set_of = lambda name: sets.select(F.col("id").alias(name), F.col("print1").alias(f"p_{name}"), F.col("shingles").alias(f"set_{name}"))

    star = members.where(one != F.col("pivot")).groupBy(F.col("pivot.rep").alias("a"), F.col("pivot.print1").alias("p_a"), F.col("rep").alias("b"), F.col("print1").alias("p_b")).agg(F.max("n").alias("n"))
    star = keep(star.withColumn("copy", F.pmod(F.xxhash64("b", "p_b"), F.ceil(F.col("n") / STARS))).drop("n"), "star")
    pivots = star.select("a", "p_a", "copy").distinct().join(set_of("a"), ["a", "p_a"])
    confirmed = keep(_confirmed(star.join(set_of("b"), ["b", "p_b"]).join(pivots, ["a", "p_a", "copy"]), percent), "confirmed")
    link = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = keep(reachable(link(confirmed)), "first")

    # Buckets of three and more that still hold several components; those with the same members count once.
    many = keep(members.where("n > 2").join(first.select(F.col("id").alias("rep"), "low"), "rep", "left").withColumn("component", F.coalesce("low", "rep")).drop("low", "pivot"), "many")
    several = many.groupBy("band", "hash").agg(F.first("n").alias("n"), F.first("sum").alias("sum"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = several.where("low <> high").groupBy("n", "sum").agg(F.min(F.struct("band", "hash")).alias("one")).select("one.band", "one.hash", "n")
    several = keep(several, "several")
    chosen = join_hot(many.drop("n", "sum"), several, ["band", "hash"], band_limit).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int"))
    chosen = chosen.withColumn("chunk", F.pmod(F.xxhash64("rep", "print1"), F.col("chunks")).cast("int"))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("first"), F.greatest(c, F.col("chunk")).alias("second"))))
    placed = chosen.join(sets.withColumnRenamed("id", "rep"), ["rep", "print1"]).select(F.xxhash64("band", "hash").alias("bucket"), F.col("rep").alias("id"), "component", "shingles", place.alias("place"))
    placed = placed.select("bucket", "place.first", "place.second", "id", "component", "shingles")
    more = keep(_compared(placed, percent), "more")
    forget(sets, star, members, many)

    found = reachable(link(confirmed.union(more))).withColumnRenamed("id", "rep")
    named = classes.select("rep", *prints, "copies").join(found, "rep", "left").select(*prints, "copies", F.coalesce("low", "rep").alias("component_id"))
    shingled = sketch.where("n_shingles > 0 and id is not null").select("id", *prints)
    alone = sketch.where("not (n_shingles > 0 and id is not null)").select("id", "n_shingles", F.col("id").alias("component_id"))
    named = join_hot(shingled, keep(named, "named"), prints, all_rows / HOT_SHARE, rows="copies")
    out = named.select("id", "n_shingles", "component_id").union(alone)
    return out.select(F.col("id").alias(key), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
