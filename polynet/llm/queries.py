"""The operators' queries over whole tables, and SQL for those that SQL can express.

Each query hands its table to its operator; nulls, empty and long texts, ties,
repeated rows, empty tables and further columns are treated as the operator's
docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, caps, chat, divergence, langid, minhash, mixing, packing, periodic, pii, quality, sharding, toxicity
from .common import short_batches, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    short_batches(spark)
    return chat.digest(chat.formatted(chat.from_table(rows)), "conv_id")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.periodic_runs(docs.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_chat_format, op3_nearest_neighbours, op4_mix_sources, op5_shard, op6_embedding_near_dedup, op7_pack, op8_minhash_near_dedup, op9_toxicity, op10_quality,
        op11_source_divergence, op12_periodic_runs, op13_personal_data,
    )
}

_CHAT_CONTROLS = r"(<)(/?s>)|(\[)(/?INST\])|(<)(/?SYS>>)|(<)(\|[A-Za-z_]+\|>)"

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '{_CHAT_CONTROLS}', '\1\3\5\7\\\2\4\6\8', 'g') AS r,
            regexp_replace(replace(text, '\', '\\'), '{_CHAT_CONTROLS}', '\1\3\5\7\\\2\4\6\8', 'g') AS t FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 13)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id""",
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets),
reps AS (SELECT h, n, min(doc_id) AS rep FROM sizes WHERE n > 0 GROUP BY h, n),
flat AS (SELECT doc_id AS id, unnest(s) AS g FROM sets SEMI JOIN reps ON reps.rep = sets.doc_id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
near AS (
  SELECT a, b FROM common JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept
FROM sizes s LEFT JOIN reps r ON r.h = s.h AND r.n = s.n LEFT JOIN component c ON c.a = r.rep""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), flat AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM flat GROUP BY ALL HAVING count(DISTINCT d) >= 3),
own AS (SELECT lang, source, term, count(*) AS c FROM flat SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups g LEFT JOIN own USING (lang, source) GROUP BY ALL),
priced AS (
  SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(o.c, 0) + 1) // (s.n + l.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v))::HUGEINT AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), met AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM priced WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op12_periodic_runs": r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h
  FROM documents, crc_table
), sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 AS g FROM docs),
periods AS (SELECT *, CASE WHEN changed THEN g % n END AS a, CASE WHEN changed THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
words AS (
  SELECT doc_id, n, i, CASE WHEN changed AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM periods)
), equal AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
collapsed AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS c FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS top FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (doc_id) LEFT JOIN collapsed USING (doc_id)""",
    # The tables hold no data of the further kinds, so their spans are the base ones.
    "op13_personal_data": r"""
WITH kinds(place, kind, pattern) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, place, kind, regexp_extract_all(text, pattern) AS m, regexp_split_to_array(text, pattern) AS gaps FROM texts, kinds),
spans AS (
  SELECT doc_id, place, kind, m[i] AS m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)
), digits AS (SELECT *, list_reverse(list_filter(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''), lambda x: x <> '')) AS d FROM spans),
checked AS (
  SELECT doc_id, place, kind, start, kind || ':' || start || ':' || (start + length(m)) AS span FROM digits
  WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0
    WHEN 'card' THEN len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE (2 * x::INT) // 10 + (2 * x::INT) % 10 END)) % 10 = 0
    WHEN 'phone' THEN len(d) BETWEEN 9 AND 15 ELSE true END
), listed AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY place, start) AS spans, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
         count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone FROM checked GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN listed USING (doc_id)""",
}
