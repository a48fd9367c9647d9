"""URL filters: host-suffix and path-prefix expressions, hash-prefix equi-join, digest check, precedence.

Runs in the JVM only. A url's expressions are (suffix of its host, prefix of its path) for every
number of labels and every path length that occurs in the rules, so the expansion is exact and its
size depends on the rules, not on the url. Rules and expressions meet on the first eight hex digits
of a SHA-256 digest; equal prefixes are then confirmed by the whole digest.

Cases: null urls and urls without ``://`` have an empty host and path and take the default verdict
unless a rule with an empty host fits; repeated pages each get their row; null or repeated page ids
are kept as they are; an empty table gives an empty result; columns of the pages that are named
host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0), F.lit(""))
    return host, path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages plus host, path, rule and verdict.

    rules: rows (action, host, path). A rule fits its host and every subdomain if the url's path
    starts with the rule's. The longest rule (host and path together) wins; among equally long
    ones the longer path, then block.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    r = rules.where("action is not null and host is not null and path is not null").select("action", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).distinct()
    shape = r.agg(F.max(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path")), F.count("*")).first()
    labels, lengths, n_rules = shape[0] or 0, sorted(shape[1] or []), shape[2]
    host, path = parts(F.col(f"`{url}`"))
    out = without(pages.withColumns({"__host": host, "__path": path}), "host", "path", "rule", "verdict")
    if not n_rules:
        return out.withColumnsRenamed({"__host": "host", "__path": "path"}).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    r = r.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("digest", 1, 8))
    ask = out.select("__host", "__path").distinct()
    split = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(split), F.lit(labels))), lambda k: F.array_join(F.slice(split, -k, k), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("__path") >= n, F.col("__path").substr(F.lit(1), n))), lambda p: p.isNotNull())
    asked = ask.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    asked = asked.withColumn("a_digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("a_digest", 1, 8))
    right = F.broadcast(r) if n_rules <= BROADCAST_RULES else r
    hits = asked.join(right, "short").where("a_digest = digest")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_path").alias("p"), (F.col("action") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("action").alias("action"))
    best = hits.groupBy("__host", "__path").agg(F.max(rank).alias("best"))
    return out.join(best, ["__host", "__path"], "left").select(
        *[F.col(f"`{c}`") for c in out.columns if c not in ("__host", "__path")],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
