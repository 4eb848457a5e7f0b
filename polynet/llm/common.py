"""Helpers that several training-data operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import HOT_SHARE, forget, join_hot, keep, keep_observed, with_before, with_rank  # noqa: F401 (for the operators)

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch. Texts are long rows: the default of 10,000 makes batches of tens of MB.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to `ARROW_ROWS`, unless it has a setting of its own. For the queries; operators leave the session alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo `modulus`: the folds of the contracts. A null key counts as ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def uniform(*cols: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def bounded_sample(df: DataFrame, by: str, key: str, rows: int, seed: int = 0) -> DataFrame:
    """About `rows` rows for each value of `by`, chosen by a hash of `key`.

    Counts the classes, then filters each by its own share, so that no class
    passes through one task. Classes are model labels: a handful of values.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, rows / n))).otherwise(share)
    return df.where(uniform(key, seed=seed) < share)


def usable(vector: Column, dim: int | None = None) -> Column:
    """True for vectors that are not null, not zero and hold finite numbers alone."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of the usable vectors (ties: the smaller); 0 if there is none."""
    row = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def blocks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to at most `most`; a longer single item stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(lengths) > start:
        out.append((start, len(lengths)))
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two line ends, and the index of each one's text."""
    joined = "".join(f"\n{t}\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    return points, owner


class LetterTable:
    """Lower-cased letters by code point; 0 stands for whatever is no letter. Filled as code points turn up."""

    UNSEEN = 0xFFFFFFFF

    def __init__(self, keep_others: bool = False) -> None:
        self.keep_others = keep_others
        self.table = np.full(0x110000, self.UNSEEN, np.uint32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        new = out == self.UNSEEN
        if new.any():
            for p in np.unique(points[new]):
                c = chr(p)
                self.table[p] = ord(c.lower()[0]) if c.isalpha() else int(p) if self.keep_others and not c.isspace() else 0
            out = self.table[points]
        return out


def squeezed(texts: list[str], letters: LetterTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their texts' indexes, runs of 0 made one. Every text starts and ends with a 0."""
    points, owner = code_points(texts)
    symbols = letters(points)
    if not len(symbols):
        return symbols, owner
    keep_it = np.ones(len(symbols), bool)
    keep_it[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    return symbols[keep_it], owner[keep_it]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 100, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept (last) of a logistic regression on a few dense columns, by Newton's method, steps halved until the loss falls."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
    x = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    total, w = weight.sum(), np.zeros(x.shape[1])
    ridge = np.array([penalty * total] * (x.shape[1] - 1) + [1e-9 * total])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ w**2 / 2)

    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        before = loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-12:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return np.append(slopes, w[-1] - slopes @ middle)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def parts(rows: int, per: int) -> int:
    return max(1, math.ceil(rows / per))
