"""Landed feeds as candidate tables (domain, url, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph import schema
from tracegraph.functions import urls
from tracegraph.operators import domains


def _finish(df: DataFrame, source: str) -> DataFrame:
    return df.select(urls.hostname("url").alias("domain"), "url", F.lit(source).alias("source")).filter("domain <> ''")


def feed_text_scan(spark: SparkSession, path: str, source: str = "openphish") -> DataFrame:
    """One URL per line; web pages only."""
    d = spark.read.text(path).select(F.trim("value").alias("url"))
    return _finish(d.filter(F.startswith("url", F.lit("http")) & domains.is_web_page_url("url")), source)


def feed_json_scan(spark: SparkSession, path: str, source: str = "phishtank") -> DataFrame:
    d = spark.read.schema("url string, phish_id string").json(path)
    return _finish(d.filter(F.col("url").isNotNull() & domains.is_web_page_url("url")), source)


def feed_csv_scan(spark: SparkSession, path: str, source: str = "urlhaus") -> DataFrame:
    """Third quoted column is the URL; # starts a comment line."""
    d = spark.read.option("comment", "#").schema("id string, dateadded string, url string, status string").csv(path)
    return _finish(d.filter(F.startswith("url", F.lit("http")) & domains.is_web_page_url("url")), source)


def feed_ct_scan(spark: SparkSession, path: str, source: str = "crt.sh") -> DataFrame:
    """Common name and newline-separated names of certificates, wildcards left out."""
    d = spark.read.schema(schema.CERT).json(path)
    cn = F.regexp_replace(F.trim(F.coalesce("common_name", F.lit(""))), r"^[*.]+", "")
    names = F.concat(F.array(cn), F.transform(F.split(F.coalesce("name_value", F.lit("")), "\n"), lambda n: F.trim(n)))
    n = d.select(F.explode(names).alias("domain")).filter("domain <> ''").filter(
        ~F.contains("domain", F.lit("*")) & F.contains("domain", F.lit("."))).distinct()
    return n.select("domain", F.concat(F.lit("https://"), "domain").alias("url"), F.lit(source).alias("source"))


def feed_scan_json(spark: SparkSession, path: str, source: str = "urlscan.io") -> DataFrame:
    d = spark.read.schema(schema.SCAN).json(path)
    return d.filter("page.domain <> ''").select(
        "page.domain", F.coalesce(F.when(F.col("page.url") != "", F.col("page.url")), F.concat(F.lit("https://"), "page.domain")).alias("url"),
        F.lit(source).alias("source"), F.coalesce("verdicts.overall.malicious", F.lit(False)).alias("malicious"),
        F.coalesce("verdicts.overall.score", F.lit(0)).alias("scan_score"), F.col("_id").alias("scan_id"))


def feed_nod_scan(spark: SparkSession, path: str, source: str = "whoisds-nod") -> DataFrame:
    d = spark.read.text(path).select(F.lower(F.trim("value")).alias("domain")).select(F.regexp_replace("domain", r"^\.+|\.+$", "").alias("domain"))
    return d.filter("domain <> ''").select("domain", F.concat(F.lit("https://"), "domain").alias("url"), F.lit(source).alias("source"))


def feed_tagged_json_scan(spark: SparkSession, path: str, source: str = "urlhaus") -> DataFrame:
    """Lines of {id: [entry, ...]}; entries whose threat or tags speak of phishing."""
    d = spark.read.text(path).select(F.explode(F.from_json("value", schema.TAGGED)).alias("id", "entries"))
    e = d.select("id", F.explode("entries").alias("e")).select("id", "e.*")
    hit = F.contains(F.lower(F.coalesce("threat", F.lit(""))), F.lit("phish")) | F.exists(
        F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("phish")))
    return e.filter(hit).select(urls.netloc("url").alias("domain"), "url", F.lit(source).alias("source"), "id")


def rank_list_scan(spark: SparkSession, path: str, top_n: int) -> DataFrame:
    """rank,domain lines: the first ``top_n`` browsable domains among the first 3 * top_n ranks."""
    d = spark.read.option("comment", "#").schema("rank int, domain string").csv(path)
    d = d.filter(F.col("rank") <= 3 * top_n).withColumn("domain", F.trim("domain")).filter(domains.is_browsable_ranked("domain"))
    d = d.orderBy("rank").limit(top_n)
    return d.select(F.concat(F.lit("https://"), "domain").alias("url"), "domain", "rank", F.lit("tranco").alias("source"))


def seed_query_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> ''")


def known_url_scan(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(F.trim("value").alias("url")).filter(F.startswith("url", F.lit("http")))
    return d.select("url", urls.domain_of("url").alias("domain")).distinct()


def url_list_scan(spark: SparkSession, path: str) -> DataFrame:
    """{"urls": [{"url", "domain", "source"}, ...]} documents."""
    d = spark.read.schema("label string, urls array<struct<url:string,domain:string,source:string>>").json(path)
    return d.select("label", F.explode("urls").alias("u")).select("label", "u.*")


def feature_scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """[{features: {...}, label}] rows as named columns."""
    inner = ",".join(f"{c}:double" for c in columns)
    return spark.read.schema(f"trace_id long, features struct<{inner}>, label string").json(path).select("trace_id", "features.*", "label")


SOURCE_NAMES = {"crt.sh": "cert_pl", "urlscan.io": "urlscan", "whoisds-nod": "nod", "lookalike": "typosquat"}  # fixed renames


def url_pool_merge(pool: DataFrame, feed: DataFrame) -> DataFrame:
    """The pool plus feed rows with new URLs, feed names mapped to pool names."""
    expr = F.col("source")
    for old, new in SOURCE_NAMES.items():
        expr = F.when(F.col("source") == old, F.lit(new)).otherwise(expr)
    new_rows = feed.select("url", "domain", expr.alias("source")).dropDuplicates(["url"]).join(pool.select("url"), "url", "left_anti")
    return pool.select("url", "domain", "source").unionByName(new_rows)


def feed_boost(scored: DataFrame) -> DataFrame:
    """Floors and bonuses by source; confirmed feeds never score below their floor."""
    s, src = F.col("score"), F.col("source")
    out = (F.when(src.isin("openphish", "phishtank"), F.greatest(s, F.lit(0.5))).when(src == "urlhaus", F.greatest(s, F.lit(0.4)))
           .when(src == "urlscan.io", F.least(s + 0.3, F.lit(1.0))).otherwise(s))
    why = (F.when(src == "openphish", "openphish_confirmed").when(src == "phishtank", "phishtank_verified")
           .when(src == "urlhaus", "urlhaus_flagged").when(src == "urlscan.io", "urlscan_flagged"))
    return scored.withColumn("boosted", F.round(out, 6)).withColumn("reasons", F.when(why.isNotNull(), F.concat("reasons", F.array(why))).otherwise(F.col("reasons")))


def points_boost(points: DataFrame) -> DataFrame:
    """+40 flagged, +20 for a scan score of 50 or more, +10 for any scan; positive totals only."""
    total = F.col("points") + F.when(F.col("malicious"), 40).otherwise(0) + F.when(F.col("scan_score") >= 50, 20).otherwise(0) + 10
    return points.withColumn("points", total).filter("points > 0")


def feed_interest_scan(scans: DataFrame, seen: DataFrame) -> DataFrame:
    """First scan per unseen domain that is worth a visit."""
    first = scans.filter("domain <> ''").groupBy("domain").agg(F.min_by("url", "scan_id").alias("url")).join(
        seen.select("domain").distinct(), "domain", "left_anti")
    return domains.is_interesting(first).filter("interesting").select("url", "domain", F.lit("urlscan_feed").alias("source"))


def jsonl_sink(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metrics_long(df: DataFrame, keys: list[str], values: list[str], decimals: int = 4) -> DataFrame:
    """Wide result rows as (name, value, text, pct): one normalised name per number."""
    arr = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(*keys, F.explode(arr).alias("m")).select(*keys, "m.*")
    name = F.regexp_replace(F.concat_ws("", *[F.initcap(F.col(k).cast("string")) for k in keys], F.initcap("metric")), "[^A-Za-z0-9]", "")
    return long.select(name.alias("name"), "metric", "value", F.format_string(f"%.{decimals}f", "value").alias("text"),
                       F.format_string("%.1f", F.col("value") * 100).alias("pct"), F.format_number("value", 0).alias("thousands"))
