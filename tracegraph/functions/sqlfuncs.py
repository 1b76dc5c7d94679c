"""Temporary SQL functions for use in spark.sql; plain SQL bodies, so they inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "tg_netloc(url STRING) RETURNS STRING": "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)",
    "tg_domain_of(url STRING) RETURNS STRING": "lower(split_part(tg_netloc(url), ':', 1))",
    "tg_entropy(s STRING) RETURNS DOUBLE": (
        "CASE WHEN coalesce(length(s), 0) = 0 THEN 0D ELSE aggregate(array_distinct(filter(split(s, ''), c -> c <> '')), 0D, "
        "(acc, c) -> acc - (length(s) - length(replace(s, c, ''))) / length(s) * log2((length(s) - length(replace(s, c, ''))) / length(s))) END"),
    "tg_code48(s STRING) RETURNS BIGINT": "cast(conv(substring(md5(s), 1, 12), 16, 10) AS BIGINT)",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
