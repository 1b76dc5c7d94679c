"""Scanning, flattening and storing recorded trace documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegraph import schema
from tracegraph.functions import urls


def trace_scan(spark: SparkSession, path: str, only_success: bool = True, multi_line: bool = False) -> DataFrame:
    """Documents below ``{path}/phishing`` and ``{path}/benign`` with the label of their folder.

    Unreadable documents are skipped; by default only successful visits are kept.
    """
    docs = spark.read.schema(schema.TRACE).option("multiLine", multi_line).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).json(path)
    label = F.regexp_extract(F.col("_metadata.file_path"), r"/(phishing|benign)/[^/]*$", 1)
    docs = docs.select("*", label.alias("folder"), F.col("_metadata.file_name").alias("file_name")).filter("_corrupt_record IS NULL").drop("_corrupt_record")
    docs = docs.withColumn("y", (F.col("folder") == "phishing").cast("int"))
    return docs.filter("success") if only_success else docs


def trace_scan_all(spark: SparkSession, path: str) -> DataFrame:
    """All readable documents with the inner trace unwrapped and its URL lifted."""
    docs = trace_scan(spark, path, only_success=False)
    return docs.withColumn("url", F.coalesce("trace.url", "url"))


def variant_scan(spark: SparkSession, path: str) -> DataFrame:
    """Documents of any shape, one a line, as VARIANT column ``v``; lines that are no JSON object are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    docs = lines.select(F.try_parse_json("value").alias("v"))
    return docs.filter(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def variant_shape(docs: DataFrame) -> DataFrame:
    """One row with the schema that all documents fit: members of different types become VARIANT in it."""
    return docs.agg(F.schema_of_variant_agg("v").alias("shape"))


def variant_events(docs: DataFrame) -> DataFrame:
    """Rows (hash, raw_idx, event_type, form_field) of the events in ``variant_scan`` documents, at the top or inside ``trace``.

    A form's fields are the sorted keys of an object, the elements of a list, or a text as it is; anything else has none.
    """
    get = lambda v, at, kind: F.try_variant_get(v, at, kind)
    many = F.coalesce(get("v", "$.trace.events", "array<variant>"), get("v", "$.events", "array<variant>"))
    e = docs.select(get("v", "$.hash", "string").alias("hash"), F.posexplode(many).alias("raw_idx", "e"))
    form = F.schema_of_variant(get("e", "$.form_data", "variant"))
    keys = F.array_sort(F.map_keys(get("e", "$.form_data", "map<string,variant>")))
    field = (F.when(F.startswith(form, F.lit("OBJECT")), F.array_join(keys, " "))
             .when(F.startswith(form, F.lit("ARRAY")), F.array_join(get("e", "$.form_data", "array<string>"), " "))
             .when(form == "STRING", get("e", "$.form_data", "string")))
    return e.select("hash", F.col("raw_idx").cast("long").alias("raw_idx"), F.coalesce(get("e", "$.event_type", "string"), F.lit("unknown")).alias("event_type"),
                    F.coalesce(field, F.lit("")).alias("form_field"))


def inner(field: str) -> Column:
    return F.coalesce(F.col(f"trace.{field}"), F.col(field))


def trace_id_of(url: str = "url") -> Column:
    return F.substring(F.md5(F.col(url)), 1, 16)


def trace_flatten(docs: DataFrame, key: str = "hash") -> dict[str, DataFrame]:
    """Nested documents as tr, ev, rq and rd rows, in the column layout of the graph operators."""
    d = docs.withColumn("trace_id", F.col(key)).withColumn("root_url", F.coalesce("trace.url", "url", F.lit("unknown")))

    def micros(c):
        return F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1_000_000).cast("long")

    def text(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[-1])

    e = d.select("trace_id", "root_url", F.posexplode(inner("events")).alias("raw_idx", "e"))
    # recorded order rules: tus is the position, ts_us the recorded time
    ev = e.select("trace_id", "root_url", F.col("raw_idx").cast("long").alias("raw_idx"), F.col("raw_idx").cast("long").alias("event_id"),
                  F.lit(0).cast("long").alias("tus"), micros("e.timestamp").alias("ts_us"),
                  F.coalesce("e.event_type", F.lit("unknown")).alias("event_type"), text("e.element_tag"), text("e.element_id"),
                  text("e.element_class"), text("e.element_text"), text("e.url_before"), text("e.url_after"),
                  F.coalesce(F.array_join(F.map_keys("e.form_data"), " "), F.lit("")).alias("form_field"))
    r = d.select("trace_id", F.posexplode(inner("network_requests")).alias("pos", "r"))
    rq = r.select("trace_id", F.col("pos").cast("long").alias("event_id"), micros("r.timestamp").alias("tus"), "r.url", "r.resource_type",
                  "r.status", "r.content_type")
    p = d.select("trace_id", F.posexplode(inner("redirects")).alias("pos", "url"), inner("redirects").alias("all"))
    rd = p.select("trace_id", F.col("pos").cast("long").alias("event_id"), F.lit(0).cast("long").alias("tus"), "url",
                  F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") > 0, F.try_element_at("all", F.col("pos"))).alias("prev_url"))
    none = F.lit(None)
    tr = d.select(
        "trace_id", F.col("root_url").alias("url"), F.coalesce("trace.final_url", "final_url", F.lit("")).alias("final_url"),
        F.coalesce("trace.page_title", "page_title", F.lit("")).alias("page_title"), F.coalesce("success", F.lit(True)).alias("success"),
        F.coalesce("forms_submitted", F.lit(0)).alias("forms_submitted"), F.coalesce("dual_submissions", F.lit(0)).alias("dual_submissions"),
        F.coalesce(F.size(inner("events")), F.lit(0)).alias("n_events"),
        F.when(F.coalesce("trace.start_time", F.lit(0.0)) > 0, F.col("trace.start_time") * 1e6).otherwise(none).alias("start_us"),
        F.when(F.coalesce("trace.end_time", F.lit(0.0)) > 0, F.col("trace.end_time") * 1e6).otherwise(none).alias("end_us"),
        F.coalesce(F.size(F.filter("trace.console_logs", lambda x: F.startswith(x, F.lit("[error]")))), F.lit(0)).alias("n_console_errors"),
        *([F.col("y")] if "y" in docs.columns else []))
    return {"tr": tr, "ev": ev, "rq": rq, "rd": rd}


def source_fallback(candidates: list[tuple[str, DataFrame]], least: int = 100) -> DataFrame:
    """The first source with enough rows, named in ``data_source``."""
    for name, df in candidates:
        if df.limit(least).count() >= least:
            return df.withColumn("data_source", F.lit(name))
    return candidates[-1][1].withColumn("data_source", F.lit(candidates[-1][0]))


def trace_promote(raw: DataFrame, stored: DataFrame, discovered: Column | None = None) -> DataFrame:
    """Successful documents not stored yet; discovery sources count as positive."""
    label = F.col("label") if discovered is None else F.when(discovered, F.lit("phishing")).otherwise(F.col("label"))
    return raw.filter("success").withColumn("label", label).join(stored.select("hash").distinct(), "hash", "left_anti")


def append_by_label(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("label").parquet(path)


def manifest(docs: DataFrame) -> DataFrame:
    """Counts and an order-free digest of the stored hashes per label."""
    from tracegraph.operators.dedup import bag_digest
    return docs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("n_hashes"),
                                     F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash"), bag_digest(F.col("hash")).alias("digest"))


def latest_snapshot(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Rows of the newest ``{prefix}*`` folder below ``root``."""
    df = spark.read.option("recursiveFileLookup", True).parquet(root)
    snap = F.regexp_extract(F.col("_metadata.file_path"), f"/({prefix}[^/]*)/", 1)
    df = df.select("*", snap.alias("snapshot"))
    newest = df.agg(F.max("snapshot").alias("m"))
    return df.filter(F.col("snapshot") == newest.scalar())


def verdict_sink(df: DataFrame, path: str) -> None:
    """Route rows to {source}/{verdict}: 1 phishing, 0 benign, anything else other."""
    v = F.when(F.col("prediction") == 1, "phishing").when(F.col("prediction") == 0, "benign").otherwise("other")
    df.withColumn("verdict", v).write.mode("append").partitionBy("source", "verdict").parquet(path)


def confirmed_archive(verdicts: DataFrame, archive: DataFrame) -> DataFrame:
    """Positive verdicts once per hash that are not archived yet."""
    return verdicts.filter("prediction = 1").dropDuplicates(["hash"]).join(archive.select("hash"), "hash", "left_anti")


def url_hash(url: str = "url", n: int = 12) -> Column:
    return F.substring(F.md5(F.col(url)), 1, n)


def domain_column() -> Column:
    return urls.domain_of("url")
