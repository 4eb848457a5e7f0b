"""Source divergence audit by duplicate-text collapse.

Equal texts of a language become one row with the number of documents that
each source has of it. Each such text is tokenised once; its document
frequencies and counts are added with those numbers as weights. Smoothed shares
of terms are whole billionths, so all results are exact.

Pairs of sources are evaluated sparsely. A term that neither source has adds
the same for all such terms; one that only one source has adds by its share
alone, so a histogram of a source's shares stands for all its terms; only terms
that both have are met one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, keep

#: Terms are kept from so many documents of a language on; terms are reported down to this rank.
LEAST_DOCS, TOP = 3, 200
#: Different (source, term) entries that a worker adds up before it hands them on.
ENTRIES = 300_000
#: Parts of a source's terms that are ranked apart first.
RANK_PARTS = 32
#: Bytes that part terms (all ASCII but letters) become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def collapsed(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """`lang`, `text`, `by_source` (array of `source`, `n`): each text of a language once. Nulls count as ''.

    Texts of more than a ten-thousandth of all rows are counted before any
    shuffle; fewer than ten thousand of them pass through a broadcast, as
    hashes. All others are shuffled once.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang), ("source", source), ("text", text))])
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    limit = rows.count() / HOT_SHARE
    many = keep(rows.groupBy("lang", "_hash").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("lang", "_hash"), "many")
    key = ["lang", "_hash"]
    hot = rows.join(F.broadcast(many), key, "left_semi")
    cold = rows.join(F.broadcast(many), key, "left_anti").repartition("lang", "text")

    def gathered(part: DataFrame) -> DataFrame:
        counted = part.groupBy("lang", "text", "source").agg(F.count("*").alias("n"))
        return counted.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("by_source"))

    return gathered(hot).unionByName(gathered(cold))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted counts and document frequencies of terms by language and source, added up as far as `ENTRIES` allow."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def taken() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in sums.items():
            names = list(count)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()), "term": pa.array(some, pa.binary()).cast(pa.string()),
                    "count": pa.array([count[t] for t in some], pa.int64()), "docs": pa.array([docs[t] for t in some], pa.int64()),
                })

    entries = 0
    for batch in batches:
        for lang, text, by_source in zip(*batch.columns, strict=True):
            words = terms(text.as_py())
            if not words:
                continue
            lang, once = lang.as_py(), None
            for one in by_source.as_py():
                count, docs = sums.setdefault((lang, one["source"]), (Counter(), Counter()))
                before = len(count)
                if one["n"] == 1:
                    count.update(words)
                    docs.update(set(words))
                else:
                    once = Counter(words) if once is None else once
                    for t, c in once.items():
                        count[t] += c * one["n"]
                        docs[t] += one["n"]
                entries += len(count) - before
            if entries > ENTRIES:
                yield from taken()
                sums.clear()
                entries = 0
    yield from taken()


def share(part: str, whole: str) -> Column:
    """1 + floor(1000000000 * part / whole), by long division: exact for any `part` up to `whole` and `whole` below 9 * 10^15."""
    out, rest = F.lit(1).cast("long"), f"({part})"
    for place in (1_000_000, 1_000, 1):
        out = out + F.expr(f"({rest} * 1000) div ({whole})") * place
        rest = f"(({rest} * 1000) % ({whole}))"
    return out


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two whole shares."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`: how far a source's terms are from other sources' and from its language's.

    Part `pair` has a row for each other source of the language, part `term`
    the `top` terms that the source has more of than its language. Ranks begin
    at 1, largest value first, equal ones by item.

    Null texts, languages and sources count as ''. Sources without terms, and
    languages that keep none (their values are 0), are there too. Repeated rows
    are documents of their own. Texts count whole at any length; further
    columns are ignored. An empty table gives an empty result.
    """
    counted = collapsed(docs, text, lang, source).select("lang", F.col("text").cast("binary").alias("text"), "by_source")
    found = counted.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    counts = keep(found.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("whole")).where(F.col("docs") >= least_docs).drop("docs")
    flat = keep(counts.drop("docs").join(known, ["lang", "term"]), "flat")

    # `size`, `held`: a source's occurrences and terms; `terms`, `all_size`: its language's.
    sources = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    own = flat.groupBy("lang", "source").agg(F.sum("count").alias("size"), F.count("*").alias("held"))
    whole = flat.select("lang", "term", "whole").distinct().groupBy("lang").agg(F.sum("whole").alias("all_size"), F.count("*").alias("terms"))
    stats = sources.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["size", "held", "terms", "all_size"])
    stats = keep(stats.withColumn("none", F.when(F.col("terms") > 0, share("1", "size + terms"))), "stats")

    # A small `stats` is broadcast by its size as a table, a large one is joined by a shuffle whose hot keys are split.
    joined = flat.join(stats, ["lang", "source"])
    priced = joined.select("lang", "source", "term", share("count + 1", "size + terms").alias("p"), share("whole + 1", "all_size + terms").alias("q"), "none")
    priced = keep(priced, "priced")

    by = ["lang", "source", "part"]
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    over = over.withColumn("_some", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))).withColumn("rank", first(*by, "_some")).where(F.col("rank") <= top).drop("_some")
    over = over.withColumn("rank", first(*by)).where(F.col("rank") <= top)

    pairs = _pairs(priced, stats).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", first(*by))
    return over.unionByName(pairs).select(*by, "item", "value", "rank")


def _pairs(priced: DataFrame, stats: DataFrame) -> DataFrame:
    """`lang`, `source`, `item`, `value` of each ordered pair of a language's sources."""
    b = lambda df, *same: df.select(*[F.col(c).alias(c if c in same else f"{c}_b") for c in df.columns])
    corrected = lambda p, q, p0, q0: apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    # Terms that both have: what they add, less what the sums below take them for. Each unordered pair once, both ways.
    met = priced.select("lang", "term", "source", "p", "none")
    met = met.join(b(met, "lang", "term"), ["lang", "term"]).where("source < source_b").groupBy("lang", "source", "source_b").agg(
        F.sum(corrected("p", "p_b", "none", "none_b")).alias("there"), F.sum(corrected("p_b", "p", "none_b", "none")).alias("back")
    )
    both = met.select("lang", "source", F.col("source_b").alias("item"), F.col("there").alias("value"))
    both = both.union(met.select("lang", F.col("source_b").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    # Terms that one has, by the histogram of its shares.
    histogram = priced.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    others = b(stats.select("lang", "source", "none"), "lang")
    single = histogram.join(others, "lang").where("source <> source_b")
    single = single.groupBy("lang", "source", "source_b").agg(F.sum(F.col("n") * apart("p", "none_b")).alias("there"), F.sum(F.col("n") * apart("none_b", "p")).alias("back"))
    ones = single.select("lang", "source", F.col("source_b").alias("item"), F.col("there").alias("value"))
    ones = ones.union(single.select("lang", F.col("source_b").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    # Terms that none has.
    rest = stats.join(b(stats, "lang", "terms"), ["lang", "terms"]).where("source <> source_b")
    left = F.when(F.col("terms") > 0, (F.col("terms") - F.col("held") - F.col("held_b")) * apart("none", "none_b")).otherwise(F.lit(0)).cast("long")
    rest = rest.select("lang", "source", F.col("source_b").alias("item"), left.alias("value"))
    return rest.union(both).union(ones).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
