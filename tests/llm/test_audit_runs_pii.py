"""Source divergence, periodic runs and personal data against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from polynet.llm import divergence, periodic, pii, queries
from polynet.llm.common import table
from tests.llm.test_operators import docs_frame

SF = "/root/testdata/sf0.001"


# Source divergence


def plain_divergence(rows, least, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t, _, _ in rows]
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for words, (_, lang, source) in zip(terms, rows, strict=True):
        groups[lang or ""].add(source or "")
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])
        price = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        q, p = price(whole), {s: price(counts[lang, s]) for s in sources}
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            over = [(-far(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("top", [3, 200])
def test_divergence_equals_plain_sums(spark, top):
    rng = random.Random(7)
    words = ["the", "THE", "The", "öl", "Öl", "a1b", "x_y", "naïve", "日本", "B", "q", "zz"]
    base = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(25)] + [None, "", " 12 !", "z" * 5000]
    rows = [(rng.choice(base), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "é", "s3"])) for _ in range(150)] + [("the same " * 3, "en", "s1")] * 400 + [(None, "xx", "only"), ("word", "yy", "a"), (None, "yy", "b")]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n long, value string")
    got = divergence.divergence(frame, top=top)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 3, top)


def test_divergence_flushes_its_sums(spark, monkeypatch):
    rows = [(f"w{i % 7} v{i}", "en", f"s{i % 3}") for i in range(60)]
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    got = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 2, 200)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(docs_frame(spark, [])).isEmpty()


# Periodic runs


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a >= q and i - a + q >= least:
                found.setdefault((a, i + q), q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng):
    n, kind = rng.randrange(600), rng.randrange(8)
    w = [rng.randrange(rng.choice([1, 2, 3, 30, 1000])) for _ in range(n)]
    if kind == 0 and n:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 2 + 1)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    elif kind == 1:
        w = ([0] * rng.randrange(20, 80) + [1]) * 9
    elif kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    elif kind == 3:
        w = [bin(i).count("1") % 2 for i in range(n)]
    elif kind == 4:
        w = [x for _ in range(8) for x in rng.choice([[0] * rng.randrange(30, 60), [0, 1] * rng.randrange(20, 40)]) + [rng.randrange(2, 4)] * rng.randrange(2)]
    elif kind == 5:
        w = [9] * rng.randrange(3) + [0, 1] * 60 + [0] + [0, 1] * 60 + [0] + [0, 1] * 30
    return w


def test_runs_equal_comparing_all_lags():
    rng = random.Random(1)
    for _ in range(8):
        texts = [odd_words(rng) for _ in range(20)]
        got = periodic.runs_of(texts)
        for i, words in enumerate(texts):
            assert got.get(i, []) == plain_runs(words)


def test_runs_of_long_texts_and_few_pairs_at_once(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = random.Random(3)
    words = [rng.randrange(10_000) for _ in range(30_000)]
    words = words[:5000] + words[:9000] * 2 + words[20_000:] + ["x"] * 40
    got = periodic.runs_of([[], words, ["x"] * 40])
    assert (9000, 18_000, 9000) not in got[1] and any(q == 9000 and n >= 18_000 for _, n, q in got[1]) and got[1][-1][2] == 1
    assert got[2] == [(0, 40, 1)]


def test_query_of_runs_equals_plain_python(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "a b " * 20), (90_001, None), (90_002, " \t\n"), (90_003, "x y " * 30), (90_004, "w " * 3000), (90_004, "w " * 3000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd).withColumn("runs", F.lit("clash"))
    plain = periodic.periodic_runs(rows.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text"))))
    got = collections.Counter(map(tuple, periodic.digest(plain).collect()))
    want = collections.Counter()
    for r in rows.collect():
        words = (r.text or "").encode().split()
        h = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 1500 or len(set(words)) > 1 else [(0, n, 1)]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert got == want
    assert periodic.periodic_runs(docs.limit(0)).isEmpty()


# Personal data


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))]
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and sum(doubled) % 10 == 0 else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.de", ".", "-", "_", "%", "+", "1", "12", "300", "255", "0001", "4111111111111111", "4111 1111-1111 1111", " ", "  ", "\n", "(743)", "555", "é", "日", "a@b.com_x@d.org", "+1 (743) 555-3824", "1.2.3.4.5", "@@", "x" * 30]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        got = [(pii.KINDS[k].name, a, b) for k, a, b, _ in pii.spans_of(text)]
        assert [s for s in got if s[0] in pii.BASE] == plain_base(text), text


def test_checks_context_and_further_kinds():
    names = lambda text: [(pii.KINDS[k].name, text[a:b]) for k, a, b, _ in pii.spans_of(text)]
    assert names("pay DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert names("pay DE88 3704 0044 0532 0130 00") == [] and names("GB82WEST12345698765432x") == []
    assert names("bank routing 021000021") == [("routing", "021000021")] and names("code 021000021") == names("bank routing 021000022") == []
    assert names("SSN 078-05-1120") == [("ssn", "078-05-1120")] and names("078-05-1120") == names("SSN 666-05-1120") == []
    assert names("call (743) 555-3824") == [("national_phone", "(743) 555-3824")] and names("call +1 (743) 555-3824") == [("phone", "+1 (743) 555-3824")]
    score = lambda text: pii.spans_of(text)[0][3]
    assert score("version 1.2.3.4") < score("1.2.3.4") < score("ip 1.2.3.4")
    assert names("version 1.2.3.4") == [("ip", "1.2.3.4")]


def test_spans_of_very_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" + " " * 400_000, "a.b@" * 100_000, "1." * 200_000, "1 " * 200_000, "A" * 400_000, "@a" * 200_000):
        pii.spans_of(text)


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "mail é日 a@b.de and 4111111111111111", "x 1.2.3.4 +1 (743) 555-3824", "a@b.de a@b.de"]
    frame = docs_frame(spark, texts).withColumn("spans", F.lit("clash"))
    found = pii.personal_data(frame.unionByName(frame))
    got = collections.Counter(map(tuple, pii.digest(found).collect()))
    want = collections.Counter()
    for i, t in enumerate(texts):
        spans = plain_base(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[i, *(sum(k == kind for k, _, _ in spans) for kind in pii.BASE), hashlib.sha256(listed.encode()).hexdigest(), listed] += 2
    assert got == want
    shown = frame.drop("spans").join(pii.personal_data(frame), "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("r")).orderBy("doc_id")
    assert [r.r for r in shown.collect()] == [None, "", "mail é日 [email] and [card]", "x [ip] [phone]", "[email] [email]"]
    assert pii.personal_data(frame.limit(0)).isEmpty()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_periodic_runs", "op13_personal_data"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    rows = lambda found, names: collections.Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
