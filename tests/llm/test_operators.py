import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from polynet.llm import ann, caps, chat, langid, minhash, mixing, packing, quality, queries, sharding, toxicity
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def docs_frame(spark, texts, sources=None):
    rows = [(i, t, None, (sources or ["a"])[i % len(sources or ["a"])], None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null, empty, blank and letterless texts, ties, repeated rows, a long text, and a column whose name clashes with results."""
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  \n\t", "123 !!", "a", "Ä é", " ".join(words), " ".join(words), "one two three four", "ONE two three four", "x" * 70_000, "</s>[INST]"]
    return docs_frame(spark, texts, ["s1", None, "s2"])


def jaccard_classes(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if z == y else z for z in label]
    return sets, label


def test_near_duplicates_equal_all_pairs(spark, odd_docs):
    random.seed(3)
    base = [[f"t{random.randrange(500)}" for _ in range(140)] for _ in range(4)]
    texts = [r.text for r in odd_docs.orderBy("doc_id").collect()]
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(random.randrange(5)):
                w[random.randrange(140)] = f"n{random.randrange(9)}"
            texts.append(" ".join(w))
    sets, label = jaccard_classes(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_frame(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].kept for i in range(len(texts))] == [label[i] == i for i in range(len(texts))]


def test_block_links_join_only_components():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**60, 100).astype(np.uint64))
    sets = [base, base[:-2], np.unique(rng.integers(0, 2**60, 100).astype(np.uint64)), base[3:]]
    links = minhash.block_links(np.array([5, 6, 7, 8]), sets, np.array([5, 5, 7, 8]), 85)
    assert {frozenset(x) for x in links} in ({frozenset((5, 8))}, {frozenset((6, 8))})


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16)) for i in range(300)]
    rows += [(300 + i, rows[i % 5][1] + rng.normal(size=16) * 0.1) for i in range(40)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, 3 * rows[0][1]), (500, None), (501, [0] * 16), (502, [None] * 16), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (505, [1.0] * 3)]
    return vectors_frame(spark, rows)


def exact_cosines(df):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect() if r.embedding is not None and len(r.embedding) == 16 and None not in r.embedding}
    ids = np.array([i for i, v in sorted(rows.items()) if np.isfinite(v).all() and v.any()])
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


def test_near_vectors_equal_all_pairs(spark, odd_vectors):
    ids, cosine = exact_cosines(odd_vectors)
    got = {r.vec_id: r for r in caps.near_vectors(odd_vectors).collect()}
    linked = cosine >= 0.9
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in ids] == linked.sum(axis=1).tolist()
    label = ids.copy()
    for _ in range(len(ids)):
        label = np.minimum(label, np.where(linked, label[None, :], 10**9).min(axis=1))
    assert [got[i].component_id for i in ids] == label.tolist()
    for i in range(500, 506):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert caps.near_vectors(odd_vectors.limit(0)).count() == 0


def test_search_recall_and_ties(spark, odd_vectors):
    ids, cosine = exact_cosines(odd_vectors)
    asked = odd_vectors.where("vec_id % 10 = 0")
    got = collections.defaultdict(list)
    for r in ann.search(odd_vectors, asked, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        row = cosine[list(ids).index(q)].copy()
        row[list(ids).index(q)] = -9
        best = ids[np.lexsort((ids, -np.round(row, 12)))[:5]]
        hits += len(set(best) & {v for v, _ in found})
        assert len(found) == 5 and all(abs(s - row[list(ids).index(v)]) < 1e-12 for v, s in found)
    assert set(got) == {i for i in ids if i % 10 == 0}
    assert hits >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[0]][:2] == [400, 401] or [v for v, _ in got[0]][:3] == [400, 401, 402]
    assert ann.search(odd_vectors.where("vec_id < 3"), odd_vectors.where("vec_id = 0"), 5).count() == 2
    assert ann.search(odd_vectors.limit(0), odd_vectors.limit(0), 5).count() == 0


def test_pairs_just_above_the_least_cosine_are_linked(spark):
    """Pairs planted at 0.90 to 0.93, with the shipped default; at most one in a thousand may be missed."""
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=(2, 1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.linspace(0.9005, 0.93, len(x))[:, None]
    frame = vectors_frame(spark, list(enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]))))
    ids, cosine = exact_cosines_of(frame, 64)
    np.fill_diagonal(cosine, 0)
    got = {r.vec_id: r.n_links for r in caps.near_vectors(frame).collect()}
    want = (cosine >= 0.9).sum(axis=1)
    lost = sum(want) - sum(got.values())
    assert want.sum() >= 2400 and all(got[i] <= n for i, n in zip(ids, want)) and lost <= 4
    exact = {r.vec_id: r.n_links for r in caps.near_vectors(frame, exact=True).collect()}
    assert [exact[i] for i in ids] == want.tolist()


def test_a_hot_group_of_near_vectors_counts_each_pair_once(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=64)
    rows = list(enumerate(np.concatenate([middle + 0.1 * rng.normal(size=(700, 64)), rng.normal(size=(100, 64))])))
    frame = vectors_frame(spark, rows)
    ids, cosine = exact_cosines_of(frame, 64)
    np.fill_diagonal(cosine, 0)
    got = {r.vec_id: r.n_links for r in caps.near_vectors(frame).collect()}
    assert [got[i] for i in ids] == (cosine >= 0.9).sum(axis=1).tolist() and max(got.values()) == 699


def exact_cosines_of(df, dim):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


def test_pigeonhole_finds_all_within_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = ann.ShardIndex(codes)
    want = np.unpackbits(codes[:50, None] ^ codes[None], axis=2).sum(axis=2) <= 22
    got = np.zeros_like(want)
    for q, c in index.candidates(codes[:50], 22):
        got[q, c] = True
    assert (got == want).all() and 0 < want.sum() < want.size
    index.lists = [np.zeros_like(x) for x in index.lists]  # what no list holds is not found
    assert not sum(len(q) for q, _ in index.candidates(codes[:50], 22))


def test_search_widens_the_radius_for_lonely_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32) + 3) for i in range(200)] + [(1000 + i, -(rng.normal(size=32) + 3)) for i in range(2)]
    frame = vectors_frame(spark, rows)
    got = ann.search(frame, frame.where("vec_id >= 1000"), 5, radius=0.1).toPandas()
    assert got.groupby("query_id").size().tolist() == [5, 5] and got.sort_values("rank").vec_id.iloc[0] in (1000, 1001)


def test_mix_meets_targets(spark):
    random.seed(4)
    texts = [" ".join(["w"] * random.choice([0, 1, 30, 500, 9000])) for _ in range(300)] + [None]
    docs = docs_frame(spark, texts, ["b", "a", None, "c", "a", "a"])
    got = mixing.mix_documents(docs).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    goal = mixing.targets({None if pd.isna(k) else k: int(v) for k, v in sizes.items()}, (5, 2, 1), 1.5, 2)
    assert abs(sum(goal.values()) - 1.5 * sizes.sum()) < 1e-6
    for s, rows in got.groupby("source", dropna=False):
        t = goal[None if pd.isna(s) else s]
        assert abs(rows.taken.sum() - t) <= 1 and (rows.target.round(6) == round(t, 6)).all()
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(texts)
    again = mixing.mix_documents(docs.repartition(7)).toPandas()
    key = lambda df: df.sort_values("doc_id")[["doc_id", "taken"]].to_numpy().tolist()
    assert key(got) == key(again)
    pieces = mixing.mix(docs).toPandas()
    words = pieces.text.str.split().str.len()
    assert words.groupby(pieces.doc_id).sum().to_dict() == got[got.taken > 0].set_index("doc_id").taken.to_dict()
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mix_keeps_columns_and_repeated_rows(spark):
    rows = [(i // 2, "a b c d e", "s", i, i, i, i, i) for i in range(40)] + [(None, None, None, 1, 1, 1, 1, 1), (None, "", None, 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, draws int, shard int, n_chars int")
    out = mixing.mix(docs, block=7)
    assert out.columns == ["doc_id", "text", "source", "size", "target", "draws", "n_chars", "shard"]
    got = out.collect()
    assert sum(len(r.text.split()) for r in got) == 300 and all(r.n_chars == len(r.text) and r.size == r.target == r.draws for r in got)
    assert mixing.mix_documents(docs).groupBy().sum("taken").first()[0] == 300 and mixing.mix_documents(docs).count() == 42


def test_hypergeometric_draws_at_any_size():
    rng = np.random.default_rng(0)
    for good, bad, n in ((50, 70, 40), (3, 1000, 100), (5, 0, 3), (0, 9, 4), (7, 7, 14)):
        drawn = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(3000)])
        mean = n * good / max(good + bad, 1)
        assert drawn.min() >= max(0, n - bad) and drawn.max() <= min(n, good) and abs(drawn.mean() - mean) < 0.3
    large = mixing._hypergeometric(rng, 3 * 10**12, 7 * 10**12, 5 * 10**12)
    assert 0 < abs(large - 1_500_000_000_000) < 10 * 725_000
    assert sum(map(sum, mixing.split_tree([4 * 10**12, 10**12], 4, 1))) == 5 * 10**12


def test_splitting_tree_is_exact():
    counts = [1000, 3, 0, 77]
    leaves = mixing.split_tree(counts, 6, 1)
    assert [sum(x) for x in zip(*leaves)] == counts
    totals = [sum(leaf) for leaf in leaves]
    assert max(totals) - min(totals) <= 2


def test_shards_match_the_mixture(spark, odd_docs):
    texts = [f"text {i}" for i in range(997)]
    docs = docs_frame(spark, texts, ["a", "a", "b", None, "a"])
    got = sharding.shard_documents(docs).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    share = got.assign(source=got.source.fillna("-")).groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (share.max() - share.min()).max() <= 2
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id]) + 8 for _, r in got.iterrows())
    odd = {r.doc_id: r for r in sharding.shard_documents(odd_docs).collect()}
    assert (odd[0]["size"], odd[0].text_crc32) == (8, 0) and len(odd) == 12
    assert sharding.shard_documents(odd_docs.limit(0)).count() == 0


def test_packing_round_trip(spark, odd_docs):
    extra = ["a  b", "a   b\n\n c \n", "we'll 's  's", "日本 語 👍 x", " lead", "trail ", "a \r\n b", "foo\x00 \x00y"]
    texts = [r.text for r in odd_docs.orderBy("doc_id").collect()] + extra
    docs = docs_frame(spark, texts)
    packed = packing.pack(docs, with_ids=True)
    got = packed.toPandas().sort_values(["doc_id", "start"])
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, rows in got.groupby("doc_id"):
        want = plain.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert [x for piece in rows.ids for x in piece] == want
        assert set(rows.doc_tokens) == {len(want)} and rows.start.tolist() == list(np.cumsum([0, *rows.length[:-1]]))
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(rows.ids, rows.ids_crc32))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == list(np.cumsum([0, *rows.length[:-1]])) and rows.length.sum() <= 2048
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    assert all(len(r.tokens) in (2048, r.n_tokens) for r in packing.sequences(packed).collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_equals_plain_search():
    random.seed(5)
    lengths = sorted((random.randrange(1, 65) for _ in range(300)), reverse=True)
    room, want = [], 0
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(64 - n)
            want += 1
    windows, offsets, number = packing.best_fit(lengths, 64)
    used = collections.Counter()
    for w, o, n in zip(windows, offsets, lengths):
        assert o == used[w]
        used[w] += n
    assert number == want and sorted(64 - u for u in used.values()) == sorted(room)


def test_chat_escape_layouts_and_digest(spark):
    odd = ["", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "<", "[", "<<SYS>>x<</SYS>>", "<|im_start|>", "<s", "a\nb", "</s", "😀é</s>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (None, 0, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.formatted(chat.from_table(table)), "conv_id").collect()}
    assert got[1].n_turns == len(odd) and got[2].n_turns == 1 and got[3].n_turns == 2
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(odd))
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    learned = "".join(odd[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[None].loss_chars == 1
    formats = [r.formatted for r in chat.formatted(chat.from_table(table)).where("conv_id = 1").collect()]
    assert formats[0].count("</s>") == formats[0].count("[INST]") == len(odd)
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"other": 1}]
    texts = [json.dumps(r) for r in records] + [None, "no json"]
    out = chat.canonical_turns(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string"), unknown="null").orderBy("i").collect()
    assert [r.layout for r in out] == ["messages", "share", "instruction", "prompt", None, None, None]
    assert all([tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in out[:4])
    with pytest.raises(Exception, match="no chat layout fits"):
        chat.canonical_turns(spark.createDataFrame([(1, '{"other": 1}')], "i int, json string")).collect()
    assert chat.formatted(out_frame := chat.canonical_turns(spark.createDataFrame([(1, None)], "i int, json string"), unknown="null")).first().formatted is None
    assert out_frame.first().turns is None


def test_fingerprints_see_every_nested_path(spark):
    turns = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "meta": {"a": {"b": [1]}}}]
    records = [{"prompt": "q", "completion": "a"}, {"a-b": 1, "prompt": "q", "completion": "a"}, {"messages": turns}, {"messages": turns[:1]}, {"messages": turns, "id": 1}, {"messages": []}, {"a.b": 1, "prompt": "q", "completion": "a"}, {"a": {"b": 1}, "prompt": "q", "completion": "a"}]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, json string")
    out = chat.canonical_turns(frame).orderBy("i").collect()
    assert len({r.print for r in out}) == len(records)
    assert [r.layout for r in out] == ["prompt", "prompt", "messages", "messages", "messages", "messages", "prompt", "prompt"]
    assert [len(r.turns) for r in out] == [2, 2, 2, 1, 2, 0, 2, 2]
    assert chat.field_paths({"messages": turns}) == {"messages[].role", "messages[].content", "messages[].meta.a.b[]"}
    typed = spark.createDataFrame([("q", "a", 1), ("q", None, 2)], "prompt string, completion string, extra int")
    assert [[tuple(t) for t in r.turns] for r in chat.from_table(typed).orderBy("extra").collect()] == [[("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "")]]
    with pytest.raises(ValueError):
        chat.from_table(typed.select("extra"))


def test_language_id(spark, odd_docs):
    docs = queries.table(spark, SF, "documents")
    got = langid.identify_documents(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in langid.identify(odd_docs.drop("lang"), langid.learn(docs, "doc_id", "text", "lang")).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4 and odd[4].lang_pred != "und"
    assert langid.identify_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, odd_docs, operator, label):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    got = operator.score_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() > 0.85 and got.score.between(0, 1).all()
    assert held.score[held[label] == 1].mean() > held.score[held[label] == 0].mean() + 0.3
    odd = operator.score_documents(odd_docs, labels.limit(0)).collect()
    assert len(odd) == 12 and len({r.score for r in odd}) == 1
    model = operator.learn(docs, labels)
    rows = odd_docs.unionByName(odd_docs).withColumns({"score": odd_docs.n_chars, "predicted": odd_docs.n_chars})
    seen = {}
    for r in operator.score(rows, model).collect():
        assert 0 <= r.score <= 1 and r.predicted in (0, 1) and seen.setdefault(r.text or "", r.score) == r.score
    assert len(seen) == 10 and sorted(operator.score(rows, model).columns) == sorted(rows.columns)
    assert operator.score_documents(docs.limit(0), labels).count() == 0


def test_queries_run_on_empty_and_clashing_columns(spark, odd_docs):
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0
    assert chat.digest(chat.formatted(chat.from_table(chat.planted(spark))), "conv_id").count() == 1
