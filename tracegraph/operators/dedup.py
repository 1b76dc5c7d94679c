"""Fingerprints, de-duplication and set operations, all by aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import ordered, urls


def code48(text: Column) -> Column:
    """48 bits of md5 as a decimal."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")


def bag_digest(text: Column) -> Column:
    """Digest of a bag of texts that needs no sorted list: count and sum of md5 codes."""
    return F.concat(F.count(text).cast("string"), F.lit(":"), F.coalesce(F.sum(code48(text)), F.lit(0)).cast("string"))


def trace_fingerprint(tr: DataFrame, ev: DataFrame, rq: DataFrame) -> DataFrame:
    """Equal for traces with the same final URL, bag of event types and set of request hosts.

    The bags enter as digests, so a trace of any length is folded while it is
    shuffled and never becomes one long text.
    """
    e = ev.groupBy("trace_id").agg(bag_digest(F.col("event_type")).alias("types"))
    hosts = rq.filter("url <> ''").select("trace_id", urls.netloc("url").alias("h")).distinct()
    h = hosts.groupBy("trace_id").agg(bag_digest(F.col("h")).alias("hosts"))
    j = tr.select("trace_id", F.coalesce("final_url", F.lit("")).alias("final_url")).join(e, "trace_id", "left").join(
        h, "trace_id", "left")
    none = F.lit("0:0")
    return j.select("trace_id", F.md5(F.concat_ws("::", "final_url", F.coalesce("types", none), F.coalesce("hosts", none)))
                    .alias("fingerprint"))


def dedup_traces(prints: DataFrame) -> DataFrame:
    """Mark the first trace of each fingerprint as unique.

    The first per fingerprint is an aggregate; the flags come from a join on the
    unique trace id, so a fingerprint shared by a third of all traces stays spread.
    """
    first = prints.groupBy("fingerprint").agg(F.min("trace_id").alias("trace_id")).withColumn("is_unique", F.lit(1))
    return prints.join(first.select("trace_id", "is_unique"), "trace_id", "left").na.fill(0, ["is_unique"])


def dedup_url(serp: DataFrame) -> DataFrame:
    key = F.regexp_replace(F.lower("url"), "/+$", "")
    return ordered.first_per_key(serp.withColumn("url_key", key), ["query", "url_key"], [F.col("engine"), F.col("position"), F.col("page_id")],
                                 ["url", "engine", "position"])


def union_sources(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def best_score_dedup(candidates: DataFrame) -> DataFrame:
    return ordered.first_per_key(candidates, ["domain"], [-F.col("score"), F.col("source_rank"), F.col("page_id")])


def combine_discoveries(candidates: DataFrame, known_urls: DataFrame) -> DataFrame:
    """First row per domain in source order; a domain whose chosen URL is known is dropped but stays taken."""
    first = ordered.first_per_key(candidates.filter("domain <> ''"), ["domain"], [F.col("source_rank"), F.col("page_id")])
    return first.join(known_urls.select("url").distinct(), "url", "left_anti")


def seen_anti(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return candidates.join(seen.select(key).distinct(), key, "left_anti")
