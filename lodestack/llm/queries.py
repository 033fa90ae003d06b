"""Registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import chunk_dedup, filter_audit, hard_negatives, jaccard_join, langid, packing, pii, quality, sentencepieces, suffix_dedup, topk, toxicity, window_packing
from lodestack.llm.common import fold, prepare

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 50, digest=True)


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, k, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT r, k, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT g, min(k) AS first, max(k) AS last FROM p GROUP BY g HAVING min(k) < max(k)),
q AS (SELECT r, i FROM p JOIN f USING (g) WHERE first < k),
b AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM q),
u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
s AS (SELECT r, run, min(i) AS low, max(i) + 50 AS high FROM u GROUP BY r, run),
k AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM s),
t AS (
  SELECT d.r, sum(high - low) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept
  FROM d JOIN k USING (r) GROUP BY d.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(toxicity.with_labels(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    held = docs.select("doc_id", "text")
    return langid.predict(held, model).withColumn("held_out", fold("doc_id", 5) == 0)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT r, doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
  FROM w),
s AS (SELECT r, unnest(grams) AS gram FROM g WHERE doc_id IS NOT NULL),
n AS (SELECT r, doc_id, len(grams) AS n FROM g),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(m.doc_id) AS component_id
FROM n JOIN reach ON reach.a = n.r JOIN n m ON m.r = reach.b GROUP BY n.r, n.doc_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_repeated_chunks(documents(spark, sf_dir)).drop("tag")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids: bytes, text: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    run = sentencepieces.coder(public_tokenizers.path("piece_bpe_32k.model"), digests, names, (pa.int64(), pa.string(), pa.string()))
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.ledger(documents(spark, sf_dir))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return ledger.select(*names, (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.CURRENT).alias("kept"), "fail_bits")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT r, i, hash(words[i:i + 7]) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM m)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g),
t AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS up,
         length(regexp_replace(text, '[^a-z]+', '', 'g')) AS low,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS ex
  FROM m LEFT JOIN t USING (r)),
b AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    | (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END)
    | (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    | (CASE WHEN up > low AND up >= 20 THEN 32 ELSE 0 END)
    | (CASE WHEN 100 * ex > 25 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    spans = F.sort_array(F.concat("base", "terms"))
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"), marks)


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS k, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
l AS (
  SELECT doc_id AS k, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (
  SELECT k, t, part, min(k) OVER (PARTITION BY t) AS first, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
      (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first < k THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l USING (k)),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.letter || b.letter || e.letter || g.letter || h.letter AS filter_order, [a.bit, b.bit, e.bit, g.bit, h.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f e ON e.bit NOT IN (a.bit, b.bit) JOIN f g ON g.bit NOT IN (a.bit, b.bit, e.bit) JOIN f h ON h.bit = 31 - a.bit - b.bit - e.bit - g.bit),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack_windows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_window_packing": op13_window_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
