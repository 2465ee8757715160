"""The queries of this folder's operators, over whole tables, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0), k=5)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), length=50)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, num=80, den=100)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = _table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import lm

    docs = _table(spark, sf_dir, "documents")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    counts = lm.count(docs, path, pattern)
    return lm.score(docs, lm.fit(docs, path, pattern, counts), path, pattern, counts)


OP8_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), c AS (
  SELECT page_id, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') END AS canonical,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h
), l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict,
  canonical
FROM c
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_byte_bpe, op3_repeated_bytes, op4_near_duplicates, op5_benchmark_leaks, op6_personal_data, op7_quality, op8_url_filter, op9_lm_score, op10_language_id)}
SQL = {"op8_url_filter": OP8_SQL}
