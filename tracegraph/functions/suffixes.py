"""Public suffixes of domains from a suffix list file, by joins.

A list has one rule a line: plain (``co.uk``), wildcard (``*.ck``: any one label in front) or exception (``!www.ck``, which beats a wildcard). Lines from
``//`` on and text after white space are comments. The longest rule that fits counts; where none does, the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rows (rule, kind) of a suffix list: kind is plain, wildcard or exception; ``rule`` comes without its sign, in lower case."""
    line = F.lower(F.split_part(F.trim(F.regexp_replace("value", r"[\t\r\x0b\f]", " ")), F.lit(" "), F.lit(1)))
    rows = spark.read.text(path).select(line.alias("l")).filter("l <> '' AND NOT startswith(l, '//')")
    kind = F.when(F.startswith("l", F.lit("!")), "exception").when(F.startswith("l", F.lit("*.")), "wildcard").otherwise("plain")
    return rows.select(F.regexp_replace("l", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind")).distinct()


def with_suffix(df: DataFrame, rules: DataFrame, domain: str = "domain") -> DataFrame:
    """Add suffix, registered and subdomain (empty where there is none) to ``df``.

    Addresses, names without a dot and nulls have no suffix; a name that is a suffix itself has no registered domain. Each distinct name is
    asked once: its tails are joined to the rules, and the longest hit of a name is an aggregate.
    """
    ip = r"^\d{1,3}(\.\d{1,3}){3}$"
    names = df.select(F.lower(F.col(f"`{domain}`")).alias("name")).filter("name IS NOT NULL").distinct()
    labels = F.split("name", r"\.")
    asked = names.filter(~F.col("name").rlike(ip) & F.contains("name", F.lit("."))).withColumn("n", F.size(labels))
    tails = asked.select("name", "n", F.posexplode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.array_join(F.slice(labels, i, F.col("n")), "."))).alias("i", "tail"))
    tails = tails.withColumn("k", F.col("n") - F.col("i"))  # labels of the tail
    hit = tails.join(rules, F.col("tail") == F.col("rule"))
    # a wildcard takes one label more than it shows, an exception one less
    size = F.when(F.col("kind") == "wildcard", F.col("k") + 1).when(F.col("kind") == "exception", F.col("k") - 1).otherwise(F.col("k"))
    best = hit.withColumn("size", size).filter("size <= n").groupBy("name").agg(
        F.max(F.when(F.col("kind") == "exception", F.col("size"))).alias("e"), F.max("size").alias("s"))
    found = asked.join(best, "name", "left").select("name", "n", F.coalesce("e", "s", F.lit(1)).alias("size"))
    tail = lambda k: F.array_join(F.slice(labels, F.col("n") - k + 1, k), ".")
    out = found.select("name", tail(F.col("size")).alias("suffix"), F.when(F.col("n") > F.col("size"), tail(F.col("size") + 1)).otherwise("").alias("registered"),
                       F.when(F.col("n") > F.col("size") + 1, F.array_join(F.slice(labels, F.lit(1), F.col("n") - F.col("size") - 1), ".")).otherwise("").alias("subdomain"))
    joined = df.withColumn("_name", F.lower(F.col(f"`{domain}`"))).join(out.withColumnRenamed("name", "_name"), "_name", "left").drop("_name")
    return joined.na.fill("", ["suffix", "registered", "subdomain"])
