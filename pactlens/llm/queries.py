"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import (
    decontaminate, fingerprint, language, lm, merkle, mixing, negatives, paragraphs, quality, sharding, simhash, substrings, urlfilter)

# The URL rules of the query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op6_substring_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs.select("doc_id", "text"), language.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_simhash_dedup, op3_decontamination, op4_sharding, op5_url_filter,
    op6_substring_removal, op7_paragraph_dedup, op8_mixing,
    op9_language_id, op10_quality_rules, op11_hard_negatives, op12_fingerprints, op13_merkle_manifest)}


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(count: str) -> str:
    return f"sha256(concat({', '.join(_field(c) for c in ('doc_id', 'source', 'lang', count, 'text'))}))"


_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
    list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT)"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op5_url_filter": f"""WITH parts AS (
  SELECT row_number() OVER () AS row_id, page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_LOWER[0]}', '{_LOWER[1]}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
ranked AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) USING (row_id)""",
    "op6_substring_removal": """WITH b AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, doc_id, unnest(range(0, length(h) // 2)) AS i,
         unnest(list_transform(range(0, length(h) // 2), lambda k: substr(h, 2 * k + 1, 2))) AS x,
         unnest(list_transform(range(0, length(h) // 2), lambda k:
           CASE WHEN 2 * k + 200 <= length(h) THEN md5(substr(h, 2 * k + 1, 200)) END)) AS g FROM b),
f AS (SELECT *, g IS NOT NULL AND (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY g) AS again FROM w),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM c),
d AS (
  SELECT r, count_if(gone) AS n_removed, count_if(begins) AS n_spans,
         string_agg(CASE WHEN gone THEN '' ELSE x END, '' ORDER BY i) AS kept FROM s GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN d USING (r)""",
    "op10_quality_rules": f"""WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, {_words("text")} AS w FROM documents),
metrics AS (
  SELECT row_id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, w
  FROM base),
windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n
  FROM (SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM metrics WHERE len(w) >= 5))),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY row_id),
counted AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM metrics LEFT JOIN covered USING (row_id)),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words
       AND NOT word_chars > {quality.MAX_MEAN_LENGTH} * n_words AS kept
FROM judged""",
    "op11_hard_negatives": """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op13_merkle_manifest": f"""WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS bent FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
trees AS (
  SELECT tree, 0 AS level, pos, leaf AS node, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM trees WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS MATERIALIZED (
  SELECT tree, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
  FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
nodes AS MATERIALIZED (
  SELECT t.tree, t.level, t.pos, t.node FROM trees t WHERE t.n > 1
  UNION ALL
  SELECT NULL, level, pos, node FROM top WHERE n > 1),
fold AS (
  SELECT doc_id, tree, leaf, 0 AS step, p.pos, height, s.pos AS place, coalesce(bent, leaf) AS node, '' AS proof,
         (SELECT max(level) FROM top) AS up, subroot
  FROM placed p JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf, f.step + 1, CASE WHEN f.step + 1 = f.height THEN f.place ELSE f.pos // 2 END, f.height, f.place,
         sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(o.node, '') || f.node ELSE f.node || coalesce(o.node, '') END),
         f.proof || coalesce(o.node, ''), f.up, f.subroot
  FROM (SELECT doc_id, tree, leaf, step, CASE WHEN step = 0 AND height = 0 THEN place ELSE pos END AS pos,
               height, place, node, proof, up, subroot FROM fold) f
  LEFT JOIN nodes o ON o.tree IS NOT DISTINCT FROM (CASE WHEN f.step < f.height THEN f.tree END)
    AND o.level = (CASE WHEN f.step < f.height THEN f.step ELSE f.step - f.height END) AND o.pos = xor(f.pos, 1)
  WHERE f.step < f.height + f.up)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM fold f, (SELECT node AS root FROM top WHERE n = 1) WHERE step = height + up""",
}


def queries() -> dict:
    """All queries of this subpackage, the pipeline included."""
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
