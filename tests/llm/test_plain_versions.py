"""Operators that SQL can't express against plain Python on small tables."""

import collections
import math
import random

import numpy as np
import pytest
import xxhash
import zstandard

from polynet.llm import langid, mixing, quality, sharding, toxicity
from polynet.llm.common import table
from tests.llm.test_operators import DOCS, docs_frame

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64 of 32-bit (given as ("int", x)), 64-bit and text values; nulls are left out."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_shards_equal_a_plain_sort(spark):
    sources = ["a", None, "b", "a"]
    docs = docs_frame(spark, [f"t{i}" for i in range(500)], sources)
    ranked = []
    for s in ("a", "b", None):
        own = sorted((i for i in range(500) if sources[i % 4] == s), key=lambda i: (spark_hash(("int", 0), str(i)), i))
        ranked += [((r + 0.5) / len(own), s is not None, s or "", spark_hash(("int", 0), str(i)), i) for r, i in enumerate(own)]
    want = {}
    for place, row in enumerate(sorted(ranked)):
        shard = place * 24 // 500
        want[row[-1]] = (shard, place - math.ceil(shard * 500 / 24))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs.select("doc_id", "source"), "doc_id", "source", 24, window_rows=70).collect()}
    assert got == want


def test_mixture_equals_plain_draws(spark):
    random.seed(9)
    block, shards, sources = 50, 5, ["a", None, "b"]
    sizes = [random.choice([0, 1, 7, 40, 300]) for _ in range(200)]
    docs = docs_frame(spark, [" ".join(["w"] * n) for n in sizes], sources)
    totals = {s: sum(n for i, n in enumerate(sizes) if sources[i % 3] == s) for s in sources}
    taken, by_shard = collections.Counter(), collections.Counter()
    for q in mixing.plan(totals, (5, 2, 1), 1.5, 2, block, shards, 0):
        stream = [(i, w) for i in sorted((i for i in range(200) if sources[i % 3] == q.source), key=lambda i: spark_hash(("int", 0), str(i))) for w in range(sizes[i])]
        cut = [stream[at : at + block] for at in range(0, len(stream), block)]
        whole = [b for b in range(len(cut)) if len(cut[b]) == block]
        order = sorted(whole, key=lambda b: spark_hash(("int", 1), q.source, b)) + [b for b in range(len(cut)) if len(cut[b]) < block]
        left = q.words
        for number in range(q.shard_ends[-1]):
            words = cut[order[number % len(cut)]][:left]
            left -= len(words)
            for i, _ in words:
                taken[i] += 1
            by_shard[sum(e <= number for e in q.shard_ends)] += len(words)
    got = mixing.mix_documents(docs, block=block, shards=shards, window_rows=30).collect()
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(taken)
    pieces = mixing.mix(docs, block=block, shards=shards, window_rows=30).toPandas()
    assert pieces.text.str.split().str.len().groupby(pieces["shard"]).sum().to_dict() == dict(by_shard)


def test_languages_equal_plain_bundles(spark):
    docs = table(spark, SF, "documents").where("length(text) < 3000").limit(60)
    profiles = langid.learn(docs, "doc_id", "text", "lang", dimensions=256)

    def bundle(text):
        letters, out = [], np.zeros(256)
        for c in f"\n{text}\n":
            x = ord(c.lower()[0]) if c.isalpha() else 0
            if x or not letters or letters[-1]:
                letters.append(x)
        for i in range(len(letters) - 2):
            v = [langid._letter_vector(letters[i + j], 256, 0).astype(int) for j in range(3)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out if any(letters) else np.zeros(256)

    rows = docs.collect()
    sums = collections.defaultdict(lambda: np.zeros(256))
    for r in rows:
        if r.lang is not None and r.text is not None:
            v = bundle(r.text)
            sums[r.lang] += np.rint(1000 * v / max(np.linalg.norm(v), 1e-9))
    names = sorted(sums)
    assert names == list(profiles.languages)
    prototypes = np.array([sums[n] / max(np.linalg.norm(sums[n]), 1e-9) for n in names])
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    for r in rows:
        v = bundle(r.text or "")
        if not v.any():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        cosine = prototypes @ v / np.linalg.norm(v)
        assert abs(got[r.doc_id].score - max(cosine.max(), 0)) < 1e-4
        assert cosine[names.index(got[r.doc_id].lang_pred)] > cosine.max() - 1e-4


def plain_hashes(text):
    letters = []
    for c in f"\n{text}\n":
        x = ord(c.lower()[0]) if c.isalpha() else 0
        if x or not letters or letters[-1]:
            letters.append(x)
    out, mask = set(), (1 << 32) - 1
    for n in toxicity.GRAMS:
        for i in range(len(letters) - n + 1):
            h = 0x9747B28C
            for x in letters[i : i + n]:
                h = (h * 0x9E3779B1 & mask) ^ x
                h ^= h >> 15
            out.add((h * 0x85EBCA6B & mask) >> (32 - toxicity.HASH_BITS))
    return out


def test_toxicity_equals_plain_sums(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.learn(docs, labels)
    texts = [r.text or "" for r in docs.where("length(text) < 2000").limit(60).collect()] + ["", "x", "Ä é"]
    got = toxicity.score(docs_frame(spark, texts), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        z = model.intercept + sum(model.weights[h] for h in plain_hashes(text))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)
    own = {r.doc_id: r for r in labels.collect() if r.toxic in (0, 1)}
    held = collections.defaultdict(lambda: [0, 0])
    counts = [0, 0]
    for r in docs.where("doc_id is not null").collect():
        if r.doc_id in own:
            counts[own[r.doc_id].toxic] += 1
            for h in plain_hashes(r.text or ""):
                held[h][own[r.doc_id].toxic] += 1
    assert set(np.flatnonzero(model.weights)) <= set(held)
    h, (other, toxic) = max(held.items(), key=lambda x: x[1][1] - x[1][0])
    value = toxicity.log_count_ratios(np.array([toxic]), np.array([other]), tuple(counts))[0]
    added = toxicity.SMOOTHING / sum(counts)
    assert value == pytest.approx(math.log(toxic / counts[1] + added) - math.log(other / counts[0] + added))


def test_quality_equals_plain_sizes(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.learn(docs, labels)
    long_text = "word " * 60_000
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", "x", long_text]
    got = quality.score(docs_frame(spark, texts), model).orderBy("doc_id").collect()

    def size(raw, dictionary):
        plain = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(plain.compress(raw[at : at + 1024])) for at in range(0, len(raw), 1024))

    for r, text in zip(got, texts):
        raw = text.encode()
        n = len(raw) + quality.SHORT_BYTES
        z = model.curve[0] * (size(raw, model.bad) - size(raw, model.good)) / n + model.curve[1] * quality.SHORT_BYTES / n + model.curve[2]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_all_text_of_a_labelled_row_is_learnt_from(spark):
    """What tells the classes apart stands at the end of long texts alone, beyond any first few chunks."""
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(1500))
    end = lambda y: " ".join(rng.choice([f"good{i}" if y else f"junk{i}" for i in range(40)]) for _ in range(600))
    rows = [(i, f"{filler()} {end(i % 2)}", None, "a", None, None) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels), threshold=0.5).where("doc_id >= 60").collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_a_repeated_id_links_by_each_of_its_texts(spark):
    from polynet.llm import minhash

    words = [[f"{c}{i}" for i in range(100)] for c in "abc"]
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(5, " ".join(words[0])), (5, " ".join(words[1])), (2, near(words[0])), (3, near(words[1])), (4, " ".join(words[2])), (4, " ".join(words[2])), (7, near(words[2]))]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (5, 2, False), (5, 2, False), (7, 4, False)]
