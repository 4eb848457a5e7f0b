"""A corpus pipeline: quality, toxicity, near-duplicates, mixture, packing.

Each stage takes the documents that its predecessor kept and returns
documents; the last one returns packed pieces. Columns beyond `COLUMNS` are
left out, whatever their names. Null and empty texts go through every stage as
empty texts: the classifiers score them by their intercepts, they are nobody's
duplicate, the mixture takes nothing of them. Texts count whole at any length.
Rows that repeat an id are scored each, and are one document from the
near-duplicates stage on; ties go to smaller ids. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polynet.llm import minhash, mixing, packing, quality, toxicity
from polynet.llm.common import forget, keep, remainder, short_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share 80 of 100 shingles; 32 bands of 6 miss one pair in 17,000 at that similarity.
NEAR_PERCENT, NEAR_BANDS = 80, 32
#: A worker that has run the stages before holds what they left, so the last one remembers half as many words.
CACHE_CHARS = 3_000_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    short_batches(spark)
    model = quality.learn(docs, _labels(spark, sf_dir))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram classifier takes for not toxic."""
    short_batches(spark)
    model = toxicity.learn(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    An id is one document: of rows that repeat it the largest by text, then the
    other columns, stays. Rows with a null id are documents of their own.
    """
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    repeated = keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        rest = [c for c in COLUMNS if c != "doc_id"]
        one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", *[c for c in rest if c != "text"])).alias("row"))
        docs = keep(docs.join(repeated, "doc_id", "left_anti").unionByName(one.select("doc_id", "row.*").select(*COLUMNS)), "single")
    dropped = minhash.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents so that sources have their target weights; some come twice."""
    short_batches(spark)
    return mixing.mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of one window."""
    short_batches(spark)
    return packing.pack(docs, cache_chars=CACHE_CHARS)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained classifiers and random draws can't be said in SQL; tests compare run() with the operators' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from `documents`; each stage's rows are written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        forget(before)  # the tables of earlier stages; `documents` is no kept table and stays
    return STAGES[-1][1](spark, docs, sf_dir)
