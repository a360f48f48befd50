"""The operators' queries, each over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import bpe, extract, langid, packing, pii, quality, simhash, suffixes, topk, urls
from clickloom.llm.common import table

RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "n_spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.page_edges(pages))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator with redirects: each page leads to the next one, five pages in a chain, so that decisions travel."""
    pages = table(spark, sf_dir, "pages")
    here, there = pages.filter("page_id % 5 <> 4").select((F.col("page_id") + 1).alias("k"), F.col("url").alias("source")), pages.select(F.col("page_id").alias("k"), F.col("url").alias("target"))
    return urls.judge(pages, RULES, here.join(there, "k").select("source", "target")).select("page_id", "verdict", "via")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents")).drop("text")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(rows, *langid.trained(docs), keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_packing, op3_quality, op4_extraction, op5_urls, op6_bpe, op7_suffixes, op8_langid, op9_simhash, op10_topk, pipeline, url_aliases)}


_TOP = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

#: Pages of the test tables name no alias, so rules alone decide there; aliases are covered by tests.
_URLS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN 'default' ELSE 'own' END AS via
FROM ruled
"""

#: The closure of the chains of url_aliases, over URLs without scheme and fragment.
_ALIASES = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^#]*', 0) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*(.*)$', 1) AS more
  FROM cut
), nodes AS (
  SELECT page_id, host, regexp_extract(more, '^[^?]*', 0) AS path, CASE WHEN host <> '' THEN host || CASE WHEN more = '' THEN '/' ELSE more END END AS node FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
    WHEN host = 'net' OR ends_with(host, '.net') THEN 'block'
  END AS own FROM nodes
), edges AS (
  SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON b.page_id = a.page_id + 1 WHERE a.page_id % 5 <> 4 AND a.node IS NOT NULL AND b.node IS NOT NULL
), sides AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges
), reach AS (SELECT u AS node, u AS other FROM sides UNION SELECT r.node, b.v FROM reach r JOIN sides b ON b.u = r.other
), said AS (
  SELECT r.node, bool_or(coalesce(x.own = 'block', FALSE)) AND NOT bool_or(coalesce(x.own = 'allow', FALSE)) AS blocked FROM reach r JOIN ruled x ON x.node = r.other GROUP BY 1
)
SELECT page_id, coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN blocked THEN 'alias' ELSE 'default' END AS via
FROM ruled LEFT JOIN said USING (node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": _URLS, "op10_topk": _TOP, "url_aliases": _ALIASES}
