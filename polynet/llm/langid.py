"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place, by multiplication; a
text's vector bundles (adds) those of all its n-grams. A language's prototype
bundles its training texts. A text gets the language whose prototype has the
largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LetterTable, blocks, bounded_sample, remainder, squeezed

DIMENSIONS, GRAM, TRAIN_ROWS = 1024, 3, 2000
#: Code points worked on at once, texts bundled at once, and n-grams bound at once.
BATCH_POINTS, BATCH_TEXTS, BATCH_GRAMS = 500_000, 256, 4096


@lru_cache(maxsize=1)
def _letters() -> LetterTable:
    return LetterTable()


@lru_cache(maxsize=200_000)
def _letter_vector(letter: int, dimensions: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, letter]).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams given as rows of letters (0: the gap between words)."""
    letters, at = np.unique(grams, return_inverse=True)
    table = np.array([_letter_vector(int(c), dimensions, seed) for c in letters])
    at, out = at.reshape(grams.shape), None
    for i in range(grams.shape[1]):
        rotated = np.roll(table, grams.shape[1] - 1 - i, axis=1)[at[:, i]]
        out = rotated if out is None else out * rotated
    return out


def bundles(texts: list[str], dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text (zero if it has no letter), and whether it has a letter."""
    symbols, owner = squeezed(texts, _letters())
    lettered = np.bincount(owner, symbols != 0, minlength=len(texts)) > 0
    out = np.zeros((len(texts), dimensions), np.float32)
    n = len(symbols) - gram + 1
    if n <= 0:
        return out, lettered
    names, small = np.unique(symbols, return_inverse=True)
    code = np.zeros(n, np.int64)
    for i in range(gram):
        code = code * len(names) + small[i : i + n]
    inside = (owner[:n] == owner[gram - 1 :]) & lettered[owner[:n]]
    code, owner = code[inside], owner[:n][inside]
    if len(names) ** gram <= 1 << 24:  # few letters: count instead of sorting
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        rank = np.zeros(len(names) ** gram, np.int32)
        rank[seen] = np.arange(len(seen))
        column = rank[code]
    else:
        seen, column = np.unique(code, return_inverse=True)
    grams = np.stack([names[seen // len(names) ** (gram - 1 - i) % len(names)] for i in range(gram)], axis=1)
    for start in range(0, len(seen), BATCH_GRAMS):
        vectors = gram_vectors(grams[start : start + BATCH_GRAMS], dimensions, seed).astype(np.float32)
        for first in range(0, len(texts), BATCH_TEXTS):
            a, b = np.searchsorted(owner, [first, first + BATCH_TEXTS])
            c, o = column[a:b] - start, owner[a:b] - first
            if start or len(seen) > BATCH_GRAMS:
                here = (c >= 0) & (c < len(vectors))
                c, o = c[here], o[here]
            counts = np.bincount(o.astype(np.int64) * len(vectors) + c, minlength=BATCH_TEXTS * len(vectors)).reshape(BATCH_TEXTS, len(vectors))
            rows = min(BATCH_TEXTS, len(texts) - first)
            out[first : first + rows] += counts[:rows].astype(np.float32) @ vectors
    return out, lettered


def _batches(pdf: pd.DataFrame, text: str) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    texts = [t if isinstance(t, str) else "" for t in pdf[text]]
    for a, b in blocks(np.array([len(t) + 2 for t in texts], np.int64), BATCH_POINTS):
        yield pdf.iloc[a:b], texts[a:b]


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes, one row a language, in order of the languages' names."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dimensions: int
    gram: int
    seed: int


def learn(labelled: DataFrame, key: str, text: str, lang: str, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 0) -> Profiles:
    """Prototypes from about `rows` texts of each language, chosen by a hash of the key.

    Each text's bundle is scaled to length 1000 and rounded, so that long texts
    count no more than short ones and the sums are exact in any order.
    Rows with a null language or text teach nothing.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = bounded_sample(known.select(key, text, lang), lang, key, rows, seed).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, texts in _batches(pdf, "text"):
                v, _ = bundles(texts, dimensions, gram, seed)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.rint(1000 * v / np.where(norm > 0, norm, 1)).astype(np.int64)
                names = sorted(set(part.lang))
                yield pd.DataFrame({"lang": names, "bundle": [v[(part.lang == x).to_numpy()].sum(axis=0) for x in names]})

    summed = sample.mapInPandas(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("place", "value"))
    summed = summed.groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    names = tuple(sorted(set(summed.lang)))
    table = np.zeros((len(names), dimensions), np.float32)
    for i, name in enumerate(names):
        own = summed[summed.lang == name]
        table[i, own.place] = own.value
        table[i] /= max(np.linalg.norm(table[i]), 1e-9)
    return Profiles(names, table, dimensions, gram, seed)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score`, the cosine with that language's prototype (0 if negative).

    `und` with score 0 if the text is null, has no letter, or no language is
    known. Ties go to the first language by name. Whole texts count, of any length.
    """

    @F.pandas_udf("lang_pred string, score double")
    def of(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in column:
            names, scores = [np.zeros(0, object)], [np.zeros(0)]
            for _, texts in _batches(pd.DataFrame({"text": series}), "text"):
                v, lettered = bundles(texts, profiles.dimensions, profiles.gram, profiles.seed)
                lettered &= len(profiles.languages) > 0
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                cosine = (v @ profiles.prototypes.T) / np.where(norm > 0, norm, 1) if profiles.languages else np.zeros((len(texts), 1))
                names.append(np.where(lettered, np.array(profiles.languages or ("und",), object)[cosine.argmax(axis=1)], "und"))
                scores.append(np.where(lettered, cosine.max(axis=1).clip(0, 1), 0.0).astype(float))
            yield pd.DataFrame({"lang_pred": np.concatenate(names), "score": np.concatenate(scores)})

    found = docs.withColumn("_found", of(text))
    return found.withColumn("lang_pred", F.col("_found.lang_pred")).withColumn("score", F.col("_found.score")).drop("_found")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from labelled rows of three folds in four (by `doc_id`), then predict all."""
    rows = docs.select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    profiles = learn(rows.where("not held_out"), "doc_id", "text", "lang")
    return identify(rows.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")
