"""Repeated ids, clashing column names and long texts in operators that other tests don't try them on."""

import collections

from pyspark.sql import functions as F

from polynet.llm import langid, minhash, packing, sharding
from tests.llm.test_operators import docs_frame

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def test_shards_of_repeated_ids(spark):
    rows = [(i % 40, f"t{i % 40}", None, "s", None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, docs_frame(spark, []).schema).withColumns({"shard": F.lit("clash"), "slot": F.lit("clash"), "law": F.lit("clash")})
    got = sharding.shard_documents(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == {i: 5 for i in range(40)}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {8, 9}


def test_pieces_of_tables_with_clashing_columns(spark):
    docs = docs_frame(spark, ["a b c", None, LONG])
    clash = docs.withColumns({c: F.lit("clash") for c in ("start", "length", "pack", "base", "sequence_id", "offset", "_piece")})
    rows = lambda df: sorted(map(str, packing.pack(df).drop("sequence_id", "offset").collect()))
    assert rows(clash) == rows(docs)


def test_near_duplicates_of_long_texts_and_clashing_columns(spark):
    docs = docs_frame(spark, [LONG, LONG + " more", LONG.upper(), "x y"])
    clash = docs.withColumns({c: F.lit("clash") for c in ("id", "bands", "print1", "n_shingles", "component_id", "copies", "n")})
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(clash).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_languages_of_long_texts_and_clashing_columns(spark):
    docs = docs_frame(spark, [("the and of to " if i % 2 else "der die und das ") * (9 if i else 20_000) for i in range(60)])
    docs = docs.withColumns({"lang": F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"), "lang_pred": F.lit("clash"), "score": F.lit("clash"), "_found": F.lit("clash")})
    got = {r.doc_id: r.lang_pred for r in langid.identify_documents(docs).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(60)}
