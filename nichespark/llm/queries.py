"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, lm, packing, quality, sharding, simhash, substring, toxicity, urlrules
from .common import prepare, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, keep_ids=False).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, SHARDS).select("doc_id", "slot", "shard")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *lm.RESULTS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text")


def op10_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op3_sql() -> str:
    slots = ",".join(map(str, sharding.lookup_table(SHARDS, sharding.TABLE_SIZE)))
    return f"""
WITH t AS (SELECT [{slots}] AS slots),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(slots[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, t"""


OP10_SQL = r"""
WITH rules(action, r_host, r_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p0 AS (SELECT page_id, url, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p1 AS (SELECT *, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM p0),
p AS (SELECT page_id, rid, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM p1),
m AS (SELECT rid, r_host || r_path AS rule, action,
             row_number() OVER (PARTITION BY rid ORDER BY length(r_host) + length(r_path) DESC, length(r_path) DESC, action DESC) AS k
      FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring, op2_pack, op3_shard, op4_decontam, op5_simhash, op6_embeddings, op7_toxicity, op8_lm, op9_quality, op10_urlrules)}


def oracle_sql() -> dict[str, str]:
    return {"op3_shard": _op3_sql(), "op10_urlrules": OP10_SQL}
