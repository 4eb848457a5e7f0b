"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of lower-cased letters in the
text. Its value is the log ratio of how often it occurs in toxic and in other
training texts; a logistic regression on the values of all features is fitted
to labelled texts, and its margins are calibrated on training texts that a fit
hasn't seen. Scoring looks up each n-gram of the whole text in one table
of a weight for each hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LetterTable, blocks, logistic, remainder, sigmoid, squeezed
from .quality import labelled_texts

GRAMS, HASH_BITS = (3, 4, 5), 20
#: Stands for no n-gram.
NONE = 1 << HASH_BITS
#: Labelled texts of each class that the classifier is fitted on, and texts added to smooth the counts.
TRAIN_ROWS, SMOOTHING = 2000, 200
BATCH_POINTS = 300_000
#: Features of training texts that are worked on at once, and weight of the squared weights in the fit.
PRESENCES, PENALTY = 500_000, 1e-4
THRESHOLD = 0.5


@lru_cache(maxsize=1)
def _letters() -> LetterTable:
    return LetterTable()


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each letter of all texts: hashes of the n-grams that begin there (`NONE`: it would leave the text); and where texts begin."""
    symbols, owner = squeezed(texts, _letters())
    symbols = symbols.astype(np.uint32)
    out = np.full((len(symbols), len(GRAMS)), NONE, np.int32)
    h = np.full(len(symbols), 0x9747B28C, np.uint32)
    for i in range(max(GRAMS)):
        h = h[: max(len(symbols) - i, 0)]
        h = h * np.uint32(0x9E3779B1) ^ symbols[i:]
        h ^= h >> np.uint32(15)
        if i + 1 in GRAMS:
            found = (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - HASH_BITS)).astype(np.int32)
            out[: len(h), GRAMS.index(i + 1)] = np.where(owner[: len(h)] == owner[i:], found, NONE)
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def distinct(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True at one place of each hash of each text."""
    flat, place = h.ravel(), np.arange(h.size, dtype=np.int32)
    last, out = np.empty(NONE + 1, np.int32), np.empty(h.size, bool)
    for a, b in zip((begins[:-1] * h.shape[1]).tolist(), (begins[1:] * h.shape[1]).tolist(), strict=True):
        own = flat[a:b]
        last[own] = place[a:b]
        out[a:b] = last[own] == place[a:b]
    return out & (flat != NONE)


def _batches(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    texts = [t if isinstance(t, str) else "" for t in pdf.text]
    for a, b in blocks(np.array([len(t) + 2 for t in texts], np.int64), BATCH_POINTS):
        yield pdf.iloc[a:b], texts[a:b]


@dataclass(frozen=True)
class Linear:
    """Weight of each hash (its log-count ratio times its learnt weight; 0: in no training text) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        h, begins = hashes(texts)
        value = self.weights[h.ravel()]
        value[~distinct(h, begins)] = 0
        return sigmoid(np.add.reduceat(value, begins[:-1] * h.shape[1]) + self.intercept)


def _present(sample: DataFrame) -> DataFrame:
    """`id`, `label` and the distinct features of each training text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, texts in _batches(pdf):
                h, begins = hashes(texts)
                once = distinct(h, begins).reshape(h.shape)
                yield pd.DataFrame({"id": part.id, "label": part.label, "present": [h[a:b][once[a:b]] for a, b in zip(begins[:-1], begins[1:], strict=True)]})

    return sample.mapInPandas(run, "id long, label int, present array<int>")


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Log of a feature's share of toxic texts over its share of others, from the numbers of texts that hold it.

    `SMOOTHING` texts are added, dealt to both kinds as all texts are, so that
    the log is 0 for a feature that is in none and near 0 for rare ones.
    """
    added = SMOOTHING / sum(texts)
    return np.log(toxic / texts[1] + added) - np.log(other / texts[0] + added)


@dataclass(frozen=True)
class Presences:
    """Features of training texts, text by text: those of text i are `column[begins[i]:begins[i + 1]]`; labels `y`, weights of texts."""

    begins: np.ndarray
    column: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    def blocks(self) -> list[tuple[int, int]]:
        return blocks(np.diff(self.begins), PRESENCES)

    def of(self, chosen: np.ndarray) -> Presences:
        """The chosen texts alone (a mask)."""
        sizes = np.diff(self.begins)
        return Presences(np.cumsum([0, *sizes[chosen]], dtype=np.int64), self.column[np.repeat(chosen, sizes)], self.y[chosen], self.weight[chosen])

    def margins(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's values at each text's features."""
        sizes, out = np.diff(self.begins), np.zeros(len(self.y))
        for i, j in self.blocks():
            some = sizes[i:j] > 0
            if some.any():
                own = table[self.column[self.begins[i] : self.begins[j]]]
                out[i:j][some] = np.add.reduceat(own, (self.begins[i:j] - self.begins[i])[some], dtype=np.float64)
        return out

    def sums(self, each: np.ndarray, features: int) -> np.ndarray:
        """Sum over the texts that hold it of each text's number, for each feature."""
        sizes, out = np.diff(self.begins), np.zeros(features)
        for i, j in self.blocks():
            out += np.bincount(self.column[self.begins[i] : self.begins[j]], np.repeat(each[i:j], sizes[i:j]), features)
        return out


def _fit(texts: Presences, value: np.ndarray, penalty: float = PENALTY, rounds: int = 40, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features scaled by `value`: weight of each feature (times its value) and intercept.

    Minimises the weighted mean loss plus `penalty` / 2 * squared weights (not
    the intercept) by limited-memory BFGS from 0, until a round lowers it by
    less than a share of `least`.
    """
    scale, share = value / max(np.abs(value).max(), 1e-12), texts.weight / texts.weight.sum()

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1]
        z = texts.margins((w * scale).astype(np.float32)) + x[-1]
        error = share * (sigmoid(z) - texts.y)
        return float(share @ (np.logaddexp(0, z) - texts.y * z) + penalty * (w @ w) / 2), np.append(scale * texts.sums(error, len(value)) + penalty * w, error.sum())

    x = np.zeros(len(value) + 1)
    x[-1] = np.log(share[texts.y == 1].sum() / share[texts.y == 0].sum())
    loss, slope = at(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # of the weights, and of the slope with them
    for _ in range(rounds):
        down, used = slope.copy(), []
        for s, u in reversed(moves):
            used.append((s @ down) / (u @ s))
            down -= used[-1] * u
        down *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 10 / max(np.abs(slope).sum(), 1e-12)
        for s, u in moves:
            down += s * (used.pop() - (u @ down) / (u @ s))
        step = 1.0
        new, new_slope = at(x - step * down)
        while new > loss - 1e-4 * step * (slope @ down) and step > 1e-9:
            step /= 2
            new, new_slope = at(x - step * down)
        if new > loss:
            break
        s, u = -step * down, new_slope - slope
        x, before, loss, slope = x + s, loss, new, new_slope
        if u @ s > 1e-10 * np.sqrt((u @ u) * (s @ s)):
            moves = [*moves[-7:], (s, u)]
        if before - loss < least * before:
            break
    return x[:-1] * scale, float(x[-1])


def _trained(texts: Presences) -> tuple[np.ndarray, float]:
    """Weight of each feature and intercept, from texts of both classes: ratios of their counts, then the fit."""
    toxic, every = texts.sums(texts.y, NONE), texts.sums(np.ones(len(texts.y)), NONE)
    held = np.flatnonzero(every)
    rank = np.zeros(NONE, np.int32)
    rank[held] = np.arange(len(held))
    value = log_count_ratios(toxic[held], (every - toxic)[held], (int((texts.y == 0).sum()), int((texts.y == 1).sum())))
    weights = np.zeros(NONE + 1)
    weights[held], intercept = _fit(Presences(texts.begins, rank[texts.column], texts.y, texts.weight), value)
    return weights, intercept


def _calibration(texts: Presences, fold: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into log odds, from margins of each half of the texts by a fit on the other."""
    margin = np.zeros(len(texts.y))
    for half in (0, 1):
        learnt = texts.of(fold != half)
        if len(set(learnt.y)) < 2:
            return 1.0, 0.0
        weights, intercept = _trained(learnt)
        margin[fold == half] = texts.of(fold == half).margins(weights) + intercept
    slope, intercept = logistic(margin[:, None], texts.y, penalty=1e-6, weight=texts.weight)
    return (float(slope), float(intercept)) if slope > 0 else (1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, seed: int = 0) -> Linear:
    """Fit on a bounded sample of about `rows` texts of each class, weighted back to the classes' shares, and calibrate.

    Two fits on half of the sample score the other half; a logistic curve on
    these margins corrects the margins of the fit on all, as a fit's margins on
    its own texts are larger than on others.

    The sample's features pass through the driver, as many 4-byte numbers as its
    texts have different n-grams (53 MB on the check tables). Without texts of both classes the score is the
    share of label 1 alone.
    """
    seen = _present(labelled_texts(docs, labels, label, rows, seed)).toArrow()
    texts = [(i.as_py(), y.as_py(), x.values.to_numpy()) for part in seen.to_batches() for i, y, x in zip(*part.columns, strict=True)]
    texts.sort(key=lambda t: t[0])
    known = {r["label"]: r["count"] for r in labels.groupBy(F.col(label).cast("int").alias("label")).count().collect() if r["label"] in (0, 1)}
    y = np.array([t[1] for t in texts], float)
    totals = int((y == 0).sum()), int((y == 1).sum())
    begins = np.cumsum([0, *(len(t[2]) for t in texts)], dtype=np.int64)
    if not all(totals) or not begins[-1]:
        share = known.get(1, 0) / max(sum(known.values()), 1)
        return Linear(np.zeros(NONE + 1), float(np.log((share + 0.01) / (1.01 - share))))
    found = Presences(begins, np.concatenate([t[2] for t in texts]), y, np.where(y == 1, known[1] / totals[1], known[0] / totals[0]))
    fold = np.random.default_rng(seed).permutation(len(texts)) % 2
    del seen, texts
    slope, shift = _calibration(found, fold)
    weights, intercept = _trained(found)
    return Linear(weights * slope, intercept * slope + shift)


def score(docs: DataFrame, model: Linear, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `score` (0 to 1, higher: toxic) and `predicted` (1 from `threshold` on); columns of these names are replaced.

    Whole texts count, of any length. A null text counts as empty, and empty
    texts score what the intercept says. Equal texts score the same; repeated
    rows stay. Other columns are kept.
    """

    @F.pandas_udf("double")
    def of(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series(np.concatenate([np.zeros(0), *[model.scores(t) for _, t in _batches(pd.DataFrame({"text": texts}))]]))

    return docs.withColumn("score", of(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of all documents, learnt from labels of rows that aren't held out."""
    held = remainder("doc_id", 5) == 0
    model = learn(docs, labels.where(~held))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
