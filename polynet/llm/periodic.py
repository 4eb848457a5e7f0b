"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with a smallest period, at least twice as long as
that and no shorter than `LEAST`, that neither neighbouring word extends.

Periods below `DIRECT` are found by comparing each word with the one a lag
ahead. Longer ones have a scale for each doubling from `DIRECT` on: at the
scale of periods [q, 2q), hashes of q/4 words have their minima in windows of
q/2 hashes. Such a window fits into a period, so the window that begins a run
comes again a period later with the same minimum at the same place: every run
has a pair of equal minimizers just its period apart. Pairs at distances of
the scale are checked by hashes of q/2 words, and those that are left seed an
extension word by word. Hashes only choose what is compared: equal words have
equal hashes, so none is missed, and what isn't equal is found out.

Pairs within one run of a known short period are left out: their distance is
a multiple of that period. Each text is worked on whole, by one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

LEAST, DIRECT = 12, 32
#: Bytes of text that a worker looks at together (one text at least), and pairs of minimizers that are checked at once.
BATCH_BYTES, PAIRS = 600_000, 1_000_000
#: Bits of a key that hold a place among the words looked at together; the others hold a hash.
PLACE_BITS = 28
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values, well mixed."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n words from those of n."""
    return h[:-n] * np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]


def _stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of consecutive numbers in sorted `at`, of those at least so long."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begins = np.concatenate([[0], cut])
    lengths = np.diff(np.concatenate([begins, [len(at)]]))
    ok = lengths >= least
    return at[begins[ok]], lengths[ok]


class Words:
    """Words of several texts as numbers, one text after another, and the runs found in them so far."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, least: int) -> None:
        self.ids, self.begins, self.least = ids, begins, least
        self.sizes = np.diff(begins)
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        #: (begin, end, period) of maximal stretches, counted from the first text's first word; not all periods are smallest.
        self.found: list[tuple[int, int, int]] = []

    def runs(self) -> dict[int, list[tuple[int, int, int]]]:
        """(start, length, period) of each text's runs, by start, then period; texts without any are left out."""
        longest = int(self.sizes.max(initial=0))
        for q in range(1, min(DIRECT - 1, longest // 2) + 1):
            self.scan(q)
        if longest >= 2 * DIRECT:
            self.scales(longest)
        smallest: dict[tuple[int, int], int] = {}
        for a, b, q in self.found:
            smallest[a, b] = min(q, smallest.get((a, b), q))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for (a, b), q in sorted(smallest.items(), key=lambda x: (x[0][0], x[1])):
            text = int(self.owner[a])
            out.setdefault(text, []).append((a - int(self.begins[text]), b - a, q))
        return out

    def scan(self, q: int) -> None:
        """All stretches of one period."""
        at = np.flatnonzero(self.ids[:-q] == self.ids[q:])
        at = at[self.owner[at] == self.owner[at + q]]
        if len(at):
            for a, n in zip(*(x.tolist() for x in _stretches(at, max(q, self.least - q))), strict=True):
                self.found.append((a, a + n + q, q))

    def scales(self, longest: int) -> None:
        """Stretches of periods from `DIRECT` on."""
        seeds = _mixed(self.ids.astype(np.uint64) | self.owner.astype(np.uint64) << np.uint64(32))
        place = np.arange(len(seeds))
        q, k = DIRECT, 1
        keep = self.sizes[self.owner] >= 2 * q
        hashes, place = seeds[keep], place[keep]  # of k words from each place on
        while k < q // 4:
            hashes, k = _joined(hashes, k), 2 * k
        while 2 * q <= longest:
            wide = _joined(hashes, k)
            keys = _mixed(hashes) & ~_PLACE | place[: len(hashes)].astype(np.uint64)
            window = 1
            while window < q // 2 and len(keys) > window:
                keys, window = np.minimum(keys[:-window], keys[window:]), 2 * window
            if len(keys):
                chosen = (keys[np.concatenate([[True], keys[1:] != keys[:-1]])] & _PLACE).astype(np.int64)
                self.pairs(np.unique(chosen), q, k, hashes, wide, place)
            q, k, hashes = 2 * q, 2 * k, wide
            keep = self.sizes[self.owner[place]] >= 2 * q
            if keep.mean() < 0.7:  # texts too short for the next scale
                hashes, place = hashes[keep[: len(hashes)]], place[keep]

    def pairs(self, chosen: np.ndarray, q: int, k: int, hashes: np.ndarray, wide: np.ndarray, place: np.ndarray) -> None:
        """Extend pairs of equal minimizers `q` to 2q - 1 words apart. `hashes` are of k words, `wide` of 2k, at `place`."""
        rank = np.searchsorted(place, chosen)
        _, kind = np.unique(hashes[rank], return_inverse=True)
        key = kind.astype(np.int64) << PLACE_BITS | chosen
        order = np.argsort(key)
        key, chosen, kind = key[order], chosen[order], kind[order].astype(np.int64) << PLACE_BITS
        beyond = np.zeros(len(self.ids) + 1, np.int64)  # first place that isn't in a known run with this one
        for a, b, d in self.found:
            if d <= k and b - a >= q + k:
                np.maximum(beyond[a : b - k + 1], b - k + 1, out=beyond[a : b - k + 1])
        low = np.searchsorted(key, kind | np.maximum(chosen + q, beyond[chosen]))
        high = np.searchsorted(key, kind | chosen + 2 * q)
        some = np.flatnonzero(high > low)
        low, counts = low[some], (high - low)[some]
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in blocks(counts, PAIRS):
            n = counts[i:j]
            a, b = chosen[np.repeat(some[i:j], n)], chosen[np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            ok = self.owner[a] == self.owner[b]
            a, b = a[ok], b[ok]
            # Of the q words or more that agree at this distance, q/2 = 2k lie before the pair or after its begin.
            at, to = np.searchsorted(place, a), np.searchsorted(place, b)
            same = lambda x, y: np.where((x >= 0) & (y < len(wide)), wide[np.clip(x, 0, len(wide) - 1)] == wide[np.clip(y, 0, len(wide) - 1)], False)
            if len(wide):
                ok = same(at, to) | same(at - 2 * k, to - 2 * k)
                seeds.append((a[ok], (b - a)[ok]))
        if seeds:
            a, lag = (np.concatenate(x) for x in zip(*seeds, strict=True))
            order = np.lexsort((a, lag))
            self.extend(a[order].tolist(), lag[order].tolist())

    def extend(self, seeds: list[int], lags: list[int]) -> None:
        """Stretches that hold the seeds, given by lag, then place."""
        i = 0
        while i < len(seeds):
            at, q = seeds[i], lags[i]
            text = self.owner[at]
            low, high = int(self.begins[text]), int(self.begins[text + 1]) - q
            end, n = at, 64
            while end < high:
                off = np.flatnonzero(self.ids[end : min(end + n, high)] != self.ids[end + q : min(end + n, high) + q])
                if len(off):
                    end += int(off[0])
                    break
                end, n = min(end + n, high), 2 * n
            begin, n = at, 64
            while begin > low:
                a = max(begin - n, low)
                off = np.flatnonzero(self.ids[a:begin] != self.ids[a + q : begin + q])
                if len(off):
                    begin = a + int(off[-1]) + 1
                    break
                begin, n = a, 2 * n
            if end - begin >= max(q, self.least - q):
                self.found.append((begin, end + q, q))
            i = bisect_left(seeds, max(end, at + 1), i + 1, bisect_right(lags, q, i))  # seeds inside lead to the same stretch


def runs_of(texts: list[list], least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words that has any."""
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    begins = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32, int(begins[-1]))
    return Words(ids, begins, least).runs()


def _worker(least: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 1, BATCH_BYTES):
                part = batch.slice(i, j - i)
                texts = [(t or b"").split() for t in part.column(1).to_pylist()]
                found = runs_of(texts, least)
                columns: list[list[int]] = [[], [], []]
                offsets, collapsed = [0], []
                for n, words in enumerate(texts):
                    for run in found.get(n, ()):
                        for column, value in zip(columns, run, strict=True):
                            column.append(value)
                    offsets.append(len(columns[0]))
                    collapsed.append(b" ".join(_left(words, found[n]) if n in found else words))
                fields = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    [key, "n_words", "runs", "collapsed"],
                )

    return run


def _left(words: list, runs: list[tuple[int, int, int]]) -> Iterator:
    """Words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return compress(words, (np.cumsum(drop[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """`key`, `n_words`, `runs` (array of `start`, `length`, `period`, by start, then period), `collapsed` for each row.

    Words are what ASCII white space parts; `start` is a word's number from 0.
    `collapsed` joins, by single spaces, the words that no run holds after its
    first period. Null, empty and blank texts have no words; of equal
    intervals the smallest period counts. Each row stands for itself, so
    repeated and null keys stay. Texts count whole: a task holds one text's
    words, some 150 bytes each, at a time. Further columns are ignored. An
    empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(key, F.col(text).cast("binary").alias(text)).mapInArrow(_worker(least, key), schema)


def planted(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys one that goes on periodically from some word, as the contract of the query says. A null key counts as ''."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    chosen = (h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))
    return F.when(chosen, F.transform(F.array(words), periodic)[0]).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, the number of runs, the longest (ties: smallest start, then period), and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    rows = found.withColumn("_longest", longest)
    rows = rows.select(key, "runs", "collapsed", F.col("_longest.length").alias("length"), (-F.col("_longest.start")).alias("start"), (-F.col("_longest.period")).alias("period"))
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
