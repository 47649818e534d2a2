"""Queries of this package over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.alignment import align_tokenizers
from feedlens.llm.hard_negatives import mine_hard_negatives
from feedlens.llm.html_text import extract_main_text, fit_weights
from feedlens.llm.language import LanguageModel, fit_languages, identify_languages
from feedlens.llm.licenses import license_digest, scan_licenses
from feedlens.llm.mixing import mix_plan
from feedlens.llm.near_text import near_duplicates
from feedlens.llm.near_vectors import near_duplicate_vectors
from feedlens.llm.neighbours import nearest_neighbours
from feedlens.llm.packing import pack_documents
from feedlens.llm.preferences import format_preferences
from feedlens.llm.urls import Rule, judge_urls
from feedlens.llm.warc import archive_round_trip

URL_RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]
TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats", "shards")


def held_out(id_col: str = "doc_id"):
    """Rows that no language is learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> LanguageModel:
    return fit_languages(docs.where(~held_out()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected side of pair n."""
    conversations = table(spark, sf_dir, "conversations")
    return format_preferences(conversations, F.expr("id div 2"), F.col("id") % 2 == 0).select(
        "pair_id", "prompt_turns", "prompt", "chosen", "rejected",
        F.aggregate("chosen_spans", F.lit(0), lambda s, x: s + x.length).cast("long").alias("chosen_trained"),
        F.aggregate("rejected_spans", F.lit(0), lambda s, x: s + x.length).cast("long").alias("rejected_trained"),
    )


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_weights(pages), keep=["url"])


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_preferences": op5_preferences,
    "op6_prefix_forest": op6_prefix_forest,
    "op7_html_text": op7_html_text,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                      WHEN len(ws) < 2 THEN [ws[1]]
                      ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS v FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.x = s.doc_id""",
    "op2_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op5_preferences": """
WITH t AS (
  SELECT conv_id AS id, list(struct_pack(turn := turn, role := replace(coalesce(role, ''), '<|', '< |'), text := replace(coalesce(text, ''), '<|', '< |'))
                             ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations GROUP BY conv_id),
p AS (
  SELECT c.id // 2 AS pair_id, c.turns AS c, r.turns AS r,
         list_filter(range(1, least(len(c.turns), len(r.turns)) + 1),
                     lambda i: c.turns[i].role <> r.turns[i].role OR c.turns[i].text <> r.turns[i].text) AS differ
  FROM t c JOIN t r ON r.id = c.id + 1 WHERE c.id % 2 = 0),
q AS (SELECT *, CASE WHEN len(differ) > 0 THEN differ[1] - 1 ELSE least(len(c), len(r)) END AS n FROM p)
SELECT pair_id, n::INT AS prompt_turns,
       coalesce(array_to_string(list_transform(c[1:n], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
       coalesce(array_to_string(list_transform(c[n + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
       coalesce(array_to_string(list_transform(r[n + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
       coalesce(list_sum(list_transform(list_filter(c[n + 1:], lambda t: t.role = 'assistant'), lambda t: length(t.text) + 8)), 0)::BIGINT AS chosen_trained,
       coalesce(list_sum(list_transform(list_filter(r[n + 1:], lambda t: t.role = 'assistant'), lambda t: length(t.text) + 8)), 0)::BIGINT AS rejected_trained
FROM q""",
    "op8_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.x = c.component_id AS kept FROM c LEFT JOIN n USING (x)""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""",
}
