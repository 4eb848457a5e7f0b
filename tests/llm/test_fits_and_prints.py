"""Fits against plain gradients, one dictionary rule, mappings by fingerprint, hot keys of near-duplicates."""

import json
import random

import numpy as np
import pytest

from polynet.llm import chat, minhash, quality, toxicity
from polynet.llm.common import logistic, sigmoid
from tests.llm.test_operators import docs_frame

# Mappings


def mapped(spark, records):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    return chat.canonical_turns(frame, unknown="null").orderBy("i").collect()


def test_empty_turn_arrays_never_beat_content(spark):
    out = mapped(spark, [{"None": [], "foo": 1}, {"messages": [], "prompt": "q", "completion": "a"}, {"messages": []}, {"conversations": [], "id": 3}, {"messages": [{}]}, {"messages": [None]}, {"messages": ["x"]}, {"messages": [], "instruction": "q", "input": "", "output": "a"}])
    assert [r.layout for r in out] == [None, "prompt", "messages", "share", None, None, None, "instruction"]
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in out] == [None, [("user", "q"), ("assistant", "a")], [], [], None, None, None, [("user", "q"), ("assistant", "a")]]


def test_types_have_the_paths_of_their_values(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind >= 5:
            return {rng.choice(["a", "b c", "x:y", "t`u", "ü", "q<>", "", "h.i", "k,l"]): value(depth - 1) for _ in range(rng.randrange(4))}
        if kind == 4:
            one = value(depth - 1)
            return [one] * rng.randrange(3)
        return [1, "s", 2.5, True][kind]

    records = [{"top": value(3), "more": value(2)} for _ in range(60)]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, json string")
    kinds = frame.selectExpr("i", "schema_of_variant(parse_json(json)) AS kind").orderBy("i").collect()
    assert [chat.kind_paths(k.kind) for k in kinds] == [chat.field_paths(r) for r in records]
    assert chat.kind_paths("ARRAY<BIGINT>") is None and chat.kind_paths("VOID") is None


def test_each_print_is_resolved_once():
    chat.layout_of.cache_clear()
    assert all(chat.layout_of(frozenset(x.paths)) is x for x in chat.LAYOUTS)
    assert chat.layout_of(frozenset(["prompt", "completion", "id"])).name == "prompt"
    assert chat.layout_of(frozenset(["prompt", "completion", "id"])).name == "prompt"
    assert chat.layout_of.cache_info().hits == 1


def test_long_conversations_come_back(spark):
    texts = ["</s>[INST] \\" * 20_000, "é" * 100_000]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(("user", "assistant"), texts, strict=True))], "conv_id long, turn int, role string, text string")
    back = chat.formatted(chat.from_table(rows)).select(chat.parsed(chat.F.col("formatted")).alias("t")).first().t
    assert [x.text for x in back] == texts


# Fits


def presences(rng, texts, features):
    sizes = rng.integers(0, 9, texts)
    column = np.concatenate([rng.choice(features, n, replace=False) for n in sizes]).astype(np.int32)
    y = (rng.random(texts) < 0.4).astype(float)
    return toxicity.Presences(np.cumsum([0, *sizes]), column, y, np.where(y == 1, 0.5, 2.0))


def test_fit_equals_a_plain_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "PRESENCES", 40)
    rng = np.random.default_rng(2)
    found = presences(rng, 120, 15)
    value = rng.normal(size=15)
    weights, intercept = toxicity._fit(found, value, penalty=1e-2, rounds=500, least=1e-12)
    x = np.zeros((120, 15))
    for i in range(120):
        x[i, found.column[found.begins[i] : found.begins[i + 1]]] = 1
    scale = value / np.abs(value).max()
    share = found.weight / found.weight.sum()
    w, b = np.zeros(15), 0.0
    for _ in range(40_000):
        error = share * (sigmoid(x @ (w * scale) + b) - found.y)
        w, b = w - 2 * (scale * (x.T @ error) + 1e-2 * w), b - 2 * error.sum()
    assert np.allclose(weights, w * scale, atol=1e-4) and abs(intercept - b) < 1e-4
    assert np.allclose(found.margins(weights), x @ weights)
    some = rng.random(120) < 0.3
    assert np.allclose(found.of(some).margins(weights), (x @ weights)[some])


def test_logistic_has_no_slope_left():
    rng = np.random.default_rng(4)
    x, weight = rng.normal(size=(300, 2)) * [5, 0.1] + [3, -7], rng.uniform(0.1, 3, 300)
    y = (x[:, 0] - 3 + 30 * (x[:, 1] + 7) + rng.normal(size=300) * 4 > 0).astype(float)
    w = logistic(x, y, penalty=1e-9, weight=weight)
    error = weight * (sigmoid(x @ w[:2] + w[2]) - y)
    assert abs(error.sum()) < 1e-3 and np.abs(x.T @ error).max() < 1e-2


def test_calibration_is_a_curve_on_margins_of_unseen_texts():
    rng = np.random.default_rng(6)
    y = (rng.random(800) < 0.2).astype(float)
    signs = [np.flatnonzero(rng.random(400) < np.where(np.arange(400) < 12, 0.35 if label else 0.05, 0.1)) for label in y]
    weight = np.where(y == 1, 1.0, 3.0)
    some = lambda at: toxicity.Presences(np.cumsum([0, *(len(signs[i]) for i in at)]), np.concatenate([signs[i] for i in at]).astype(np.int32), y[at], weight[at])
    fold = np.arange(800) % 2
    slope, shift = toxicity._calibration(some(np.arange(800)), fold)
    margin = np.zeros(800)
    for half in (0, 1):
        weights, intercept = toxicity._trained(some(np.flatnonzero(fold != half)))
        margin[fold == half] = [weights[signs[i]].sum() + intercept for i in np.flatnonzero(fold == half)]
    error = weight * (sigmoid(slope * margin + shift) - y) / weight.sum()
    assert slope > 0 and abs(error.sum()) < 1e-4 and abs(error @ margin) < 1e-4
    assert toxicity._calibration(some(np.flatnonzero((y == 0) | (fold == 0))), fold[(y == 0) | (fold == 0)]) == (1.0, 0.0)


@pytest.mark.parametrize("chunks", [[], [b""], [b"a"], [b"abc", b"d"], [b"x" * 1024] * 3, [bytes(range(256)) * 4], [b"lorem ipsum " * 30, b"dolor"]])
def test_one_rule_makes_dictionaries_of_any_text(chunks):
    made = quality._dictionary(chunks)
    assert bool(made) == any(chunks) and made == quality._dictionary(chunks)
    assert quality.Compressed(made, b"", (1.0, 0.0, 0.0)).inputs(["some text", ""]).shape == (2, 2)


# Hot keys


def test_a_fifth_of_all_rows_with_one_text_meets_in_no_task(spark):
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(40))
    n = 50_000
    texts = [hot if i % 5 == 0 else f"{rng.random()} {rng.random()} w{i} {rng.random()} x {i}" for i in range(n)]
    docs = docs_frame(spark, texts).withColumnRenamed("kept", "component_id").repartition(32)
    found = minhash.near_duplicates(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == n
    assert all(rows[i].component_id == (0 if i % 5 == 0 else i) for i in range(n))
    # the rows of the hot text are joined by a broadcast: no exchange of the last join has them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2
