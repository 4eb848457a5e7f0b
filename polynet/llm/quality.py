"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text is compressed with both, chunk by chunk; the difference of the
two sizes over the text's size says which kind it is more like, and a logistic
curve fitted on labelled texts that built no dictionary turns it into a score.
Short texts say little: sizes count with `SHORT_BYTES` added, and the share of
these in the sum is the curve's second input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, logistic, remainder, sigmoid

#: Labelled texts of each class for the dictionaries, and as many for the curve.
TRAIN_ROWS = 2000
CHUNK_BYTES, SHORT_BYTES, DICTIONARY_BYTES, LEVEL = 1024, 128, 112_640, 3
#: Segment and gram sizes of the dictionaries' training; given, they need not be searched for.
K, D = 200, 8
#: Score from which a text counts as good.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Compressed:
    """The two dictionaries (empty: no labelled text of that class) and the curve's two slopes and intercept."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float]

    def inputs(self, texts: list[str]) -> np.ndarray:
        """Rows of (size with the bad dictionary - size with the good one) / size, and shortness (1 for empty texts)."""
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw), CHUNK_BYTES):
                chunk = raw[at : at + CHUNK_BYTES]
                out[i, 0] += len(bad.compress(chunk)) - len(good.compress(chunk))
            out[i] = np.array([out[i, 0], SHORT_BYTES]) / (len(raw) + SHORT_BYTES)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.inputs(texts) @ np.array(self.curve[:2]) + self.curve[2])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    lean = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**lean)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **lean)


def _dictionary(chunks: list[bytes]) -> bytes:
    """Trained on all chunks, gone through as often as makes ten times `DICTIONARY_BYTES`; empty without any text."""
    there = sum(map(len, chunks))
    if not there:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, chunks * -(-10 * DICTIONARY_BYTES // there), k=K, d=D).as_bytes()


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """`id`, `text`, `label` (0 or 1) of about `rows` texts of each class, an id once.

    Rows with null ids or labels, or with a label other than 0 and 1, teach
    nothing; an id with several labels counts with the largest, one with
    several texts with the last in order; a null text is empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = bounded_sample(known, "label", "doc_id", rows, seed)  # at most about 2 * rows ids: small enough to broadcast
    found = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id")
    return found.groupBy("id", "label").agg(F.max("text").alias("text")).select("id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, seed: int = 0) -> Compressed:
    """Fit on a bounded sample of `rows` whole texts of each class for the dictionaries, and as many others for the curve."""
    sample = labelled_texts(docs, labels, label, 2 * rows, seed)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, y in zip(pdf.id, pdf.text, pdf.label, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                out += [(i, c, y, raw[c : c + CHUNK_BYTES]) for c in range(0, len(raw), CHUNK_BYTES)]
            yield pd.DataFrame(out, columns=["id", "place", "label", "chunk"])

    chunks = sample.where("fold = 0").mapInPandas(cut, "id long, place int, label int, chunk binary").toPandas().sort_values(["id", "place"])
    good, bad = (_dictionary([bytes(x) for x in chunks.chunk[chunks.label == y]]) for y in (1, 0))
    plain = Compressed(good, bad, (1.0, 0.0, 0.0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            difference, short = plain.inputs(pdf.text.tolist()).T
            yield pd.DataFrame({"id": pdf.id, "label": pdf.label, "difference": difference, "short": short})

    seen = sample.where("fold = 1").mapInPandas(measure, "id long, label int, difference double, short double").toPandas().sort_values("id")
    counts = {r["label"]: r["count"] for r in labels.groupBy(F.col(label).cast("int").alias("label")).count().collect() if r["label"] in (0, 1)}
    if set(seen.label) != {0, 1}:
        prior = counts.get(1, 0) / max(sum(counts.values()), 1)
        return Compressed(good, bad, (0.0, 0.0, float(np.log((prior + 0.01) / (1.01 - prior)))))
    weight = np.array([counts[y] / max((seen.label == y).sum(), 1) for y in seen.label])
    curve = logistic(seen[["difference", "short"]].to_numpy(), seen.label.to_numpy(float), penalty=1e-6, weight=weight)
    return Compressed(good, bad, tuple(map(float, curve)))


def score(docs: DataFrame, model: Compressed, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `score` (0 to 1, higher: good) and `predicted` (1 from `threshold` on); columns of these names are replaced.

    Whole texts count, of any length, in chunks. A null text counts as empty,
    and empty texts score what the curve says of shortness alone. Equal texts
    score the same; repeated rows stay. Other columns are kept.
    """

    @F.pandas_udf("double")
    def of(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series(model.scores([t if isinstance(t, str) else "" for t in texts]))

    return docs.withColumn("score", of(text)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of all documents, learnt from labels of rows that aren't held out."""
    held = remainder("doc_id", 5) == 0
    model = learn(docs, labels.where(~held))
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
