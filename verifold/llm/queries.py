"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, importance, langid, lm, mixing, neighbors, oracles, quality, quotes, repair, secret_scan, simhash, urls, warc
from .common import table


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op2_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid, placements = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(laid, placements).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_ts")


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op6_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.sha2(secret_scan.listed(secret_scan.KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", *sizes[:3], base.alias("base_sha256"), secret_scan.listed(secret_scan.KINDS).alias("spans"), sizes[3])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations")).report()


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbors.nearest(vectors, vectors.where("id % 100 = 0"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_links": op1_quotation_links,
        "op2_quality_ratio": op2_quality_ratio,
        "op3_source_mix": op3_source_mix,
        "op4_warc_index": op4_warc_index,
        "op5_backoff_lm": op5_backoff_lm,
        "op6_bm25_leaks": op6_bm25_leaks,
        "op7_markov_secrets": op7_markov_secrets,
        "op8_simhash": op8_simhash,
        "op9_mixture_langid": op9_mixture_langid,
        "op10_url_verdicts": op10_url_verdicts,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_cross_polytope": op12_cross_polytope,
        "op13_importance_resample": op13_importance_resample,
        "pipeline": pipeline,
    }


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
  strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS capture_ts
FROM p LEFT JOIN first ON p.payload_digest = first.payload_digest AND p.payload_bytes >= 100
"""

OP10_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), urls AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), ruled AS (
  SELECT s.*, r.h || r.p AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, url, md5(html) ORDER BY length(r.h || r.p) DESC NULLS LAST) AS n
  FROM split s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
), tags AS (
  SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM pages)
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS tag FROM pages)
), placed AS (
  SELECT url, link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1) AS folder FROM tags WHERE url IS NOT NULL AND link <> ''
), links AS (
  SELECT DISTINCT url AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN root || link WHEN folder = '' THEN root || '/' || link ELSE folder || link END AS b FROM placed
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, other) AS (
  SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
), parts AS (
  SELECT DISTINCT other, translate(regexp_extract(substr(other, strpos(other, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(other, strpos(other, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM reach WHERE contains(other, '://')
), judged AS (
  SELECT other, arg_max(r.verdict, length(r.h || r.p)) AS verdict FROM parts JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY other
), said AS (
  SELECT node, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS said FROM reach JOIN judged ON judged.other = reach.other GROUP BY node
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE said WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN said ON said.node = ruled.url WHERE n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_index": OP4_SQL, "op10_url_verdicts": OP10_SQL, "op11_conversation_repair": oracles.OP11_SQL, "op13_importance_resample": oracles.OP13_SQL}
