from collections import Counter

import corpus_pipeline
from polynet.llm import packing
from polynet.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_run_equals_them(spark):
    docs = table(spark, SF, "documents")
    sizes, columns = [docs.count()], None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        sizes.append(out.count())
        columns = out.columns
        if name in ("quality", "toxicity", "near_duplicates"):
            assert columns == list(corpus_pipeline.COLUMNS) and sizes[-1] < sizes[-2]
            assert out.select("doc_id").distinct().count() == sizes[-1]
        docs = out
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) == sizes[-1] and set(got.columns) == set(columns)
    want = Counter(docs.toPandas()[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert Counter(got[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert got.groupby("sequence_id").length.sum().max() <= packing.WINDOW
