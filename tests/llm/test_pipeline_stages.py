import random

import corpus_pipeline
from tests.llm.test_operators import DOCS, jaccard_classes

SF = "/root/testdata/sf0.001"


def test_near_duplicates_stage_equals_all_pairs_at_80(spark):
    random.seed(5)
    texts, between = [], 0
    for _ in range(6):
        base = [f"t{random.randrange(900)}" for _ in range(140)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3):
            w = list(base)
            for i in range(changes):
                w[20 + 40 * i] = f"n{random.randrange(900)}"
            texts.append(" ".join(w))
    sets, label = jaccard_classes(texts, 80)
    between = sum(80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert between and label != jaccard_classes(texts, 85)[1]
    rows = [(i, t, None, "a", None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect())
    assert got == sorted(set(label))


def test_near_duplicates_stage_keeps_one_row_of_an_id(spark):
    rows = [(1, "a b c d e f g", None, "a", None, None)] * 3 + [(2, None, None, "a", None, None), (2, "other words stand in here", None, "a", None, None)]
    rows += [(3, "", None, "a", None, None)] * 2 + [(None, "h i j", None, "a", None, None)] * 2
    got = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "h i j"), (0, "h i j"), (1, "a b c d e f g"), (2, "other words stand in here"), (3, "")]


def test_stages_take_odd_documents(spark):
    """Null, empty and long texts, null ids and sources, repeated rows and further columns with clashing names; and none at all."""
    from pyspark.sql import functions as F

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words without an id stand here now", None, "a", None), (3, "long " * 50_000, "en", "b", 1), (4, "a b c d e f g", "en", "a", 1), (4, "a b c d e f g", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in ("score", "predicted", "size", "target", "shard", "row", "kept", "component_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
        ids = sorted(r.doc_id or 0 for r in out.select("doc_id").collect())
        assert set(ids) <= {0, 1, 2, 3, 4}
        if name == "near_duplicates":
            assert ids == [0, 1, 2, 3, 4]
        if name == "mixing":
            assert set(ids) <= {0, 3, 4}
        if name == "packing":
            assert set(ids) == {0, 1, 2, 3, 4} and ids.count(4) == 2
        assert stage(spark, docs.limit(0), SF).count() == 0
