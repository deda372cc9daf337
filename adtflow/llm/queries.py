"""The queries opN_<name> of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.llm import (
    chat,
    decontaminate,
    fingerprints,
    jaccard_join,
    packing,
    pseudo_likelihood,
    quality,
    suffix_dedup,
    token_counts,
    url_rules,
)
from adtflow.llm.common import table


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.with_next(table(spark, sf_dir, "documents"), {"sketch": fingerprints.sketch(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    docs = docs.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.to_text(F.col("sketch")).alias("fingerprint"), fingerprints.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
roles AS (
  SELECT t.*, perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
heads AS (
  SELECT *, CASE WHEN role = 'user' THEN regexp_replace(speaker, '<(\\*)\|', '<\1\\|', 'g') ELSE '' END AS name FROM roles),
rows_ AS (
  SELECT *, '<|' || role || '|>' || name || chr(10) || content || '<|end|>' || chr(10) AS rendered,
         length('<|' || role || '|>' || name) + 1 AS head
  FROM heads),
placed AS (
  SELECT *, length(rendered) AS length,
         coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows_)
SELECT conv_id, perspective, turn, role, name, rendered, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(start + CASE WHEN role = 'assistant' THEN head ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN length - head - 1 ELSE 0 END AS BIGINT) AS mask_length
FROM placed
"""

def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_likelihood.learn_and_score(docs)


#: (rule, verdict) of op8.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([url_rules.parse_rule(*r) for r in URL_RULES], "host string, path string, verdict string")
    return url_rules.apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP8_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed p LEFT JOIN best b ON p.page_id = b.page_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT g, list(doc_id) AS docs FROM s GROUP BY g HAVING count(*) > 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.g IN (SELECT g FROM g) GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.doc_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_sequences, op2_suffix_dedup, op3_token_counts, op4_benchmark_leaks, op5_fingerprints, op6_chat_perspectives,
        op7_pseudo_likelihood, op8_url_filters, op9_quality_rules, op10_jaccard_classes,
    )
}
ORACLE_SQL = {"op6_chat_perspectives": OP6_SQL, "op8_url_filters": OP8_SQL, "op10_jaccard_classes": OP10_SQL}
