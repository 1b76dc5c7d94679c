"""Streaming jobs run to completion over landed tables and compared with their batch meaning."""

from pyspark.sql import functions as F

from tracegraph import schema
from tracegraph.operators import domains
from tracegraph.plans.base_sql import ALL, GRAPH, HOSTS, I, R, sql
from tracegraph.plans.cat_rules import DS, RISK_CTE
from tracegraph.plans.cat_scan import CHUNKS, chunk_docs
from tracegraph.plans.cat_stats import RUNS, runs
from tracegraph.plans.registry import query
from tracegraph.session import land, scratch_path
from tracegraph.streaming import streams


def landed_stream(t, df, files=4):
    """Land a batch table as a few files and open it as a stream."""
    path = scratch_path(t.spark, "landing")
    df.repartition(files).write.parquet(path)
    schema = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    return streams.read_stream(t.spark, path, schema, files_per_batch=2)


def drained(t, df, mode="append"):
    out = scratch_path(t.spark, "stream-out")
    streams.run_available(df, out, scratch_path(t.spark, "stream-checkpoint"), mode)
    return t.spark.read.schema(df.schema).parquet(out)


def stamp():
    return F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id") * 1000000)


@query("candidate_stream", sql(HOSTS + DS, f"SELECT DISTINCT domain, {R('score')} AS score FROM ds WHERE score >= 0.2"))
def _(t):
    feed = landed_stream(t, t.hosts.select("domain", "url", stamp().alias("ts")))
    return drained(t, streams.candidate_stream(feed).select("domain", "score"))


@query("seen_state", sql(HOSTS, "SELECT DISTINCT domain FROM hosts"))
def _(t):
    return drained(t, streams.seen_state(landed_stream(t, t.hosts.select("domain"))).select("domain"))


def docs(t):
    return t.tr.select(F.md5(F.col("trace_id").cast("string")).alias("hash"), "trace_id", "url", "success", "y", F.col("forms_submitted").alias("forms"),
                       F.when(F.col("y") == 1, "phishing").otherwise("benign").alias("label"), F.lit("feed").alias("source"),
                       F.timestamp_micros("start_us").alias("ts"))


DOC_GRAPH = CHUNKS + """,
dev AS (SELECT hash AS trace_id, pos AS raw_idx, url_before, url_after, event_type, element_tag, element_id, element_class, tus, form_field,
   first_value(page_url) OVER (PARTITION BY hash ORDER BY pos) AS root_url FROM cd),
drd AS (SELECT hash AS trace_id, page_url AS url, pos, lag(page_url) OVER (PARTITION BY hash ORDER BY pos) AS prev_url FROM cd),
dtr AS (SELECT trace_id, any_value(root_url) AS url FROM dev GROUP BY 1)""" + GRAPH.replace("FROM ev ", "FROM dev ").replace("FROM rd", "FROM drd").replace("FROM tr", "FROM dtr")


@query("trace_stream_verdict", sql(ALL + DOC_GRAPH + RISK_CTE, f"""SELECT trace_id AS hash, CASE WHEN risk_score > 0.5 THEN 'phishing' ELSE 'benign' END AS verdict,
  {R('CASE WHEN risk_score > 0.5 THEN risk_score ELSE 1 - risk_score END')} AS confidence, risk_factors, 'heuristic' AS method FROM risk"""))
def _(t):
    d = chunk_docs(t).withColumn("source", F.lit("feed"))
    # every fifth document comes twice, in files of different batches
    path, out, chk = scratch_path(t.spark, "landing"), scratch_path(t.spark, "verdicts"), scratch_path(t.spark, "stream-checkpoint")
    again = F.when(F.crc32("hash") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d.withColumn("again", F.explode(again)).repartitionByRange(2, "again").drop("again").write.json(path)
    for _ in range(2):  # the second run finds nothing new
        streams.trace_stream_verdict(streams.read_stream(t.spark, path, schema.TRACE, "json", files_per_batch=1), out, chk).awaitTermination()
    return t.spark.read.parquet(out).select("hash", "verdict", "confidence", "risk_factors", "method")


@query("promote_stream", sql(ALL, "SELECT CASE WHEN y = 1 THEN 'phishing' ELSE 'benign' END AS label, count(*) AS n FROM tr WHERE success GROUP BY 1"))
def _(t):
    out = scratch_path(t.spark, "promoted")
    streams.promote_stream(landed_stream(t, docs(t)), out, scratch_path(t.spark, "stream-checkpoint")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def updates(t, df, keys, name):
    """Run an update-mode stream and keep the last row of each key."""
    out = scratch_path(t.spark, "updates")

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/id={batch_id}")

    q = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", scratch_path(t.spark, "stream-checkpoint")).trigger(
        availableNow=True).start()
    q.awaitTermination()
    d = t.spark.read.parquet(out)
    rest = [c for c in df.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


CYC = """count(*) AS processed, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND y = 1) AS phishing"""


@query("cycle_stats_stream", sql(ALL, f"SELECT start_us // 604800000000 AS week, {CYC} FROM tr GROUP BY 1"))
def _(t):
    s = streams.cycle_stats_stream(landed_stream(t, docs(t)), "1 hour", "100 days")
    u = updates(t, s, ["start"], "cycle")
    week = F.floor(F.unix_micros("start") / 604800000000)
    return u.groupBy(week.alias("week")).agg(*[F.sum(c).alias(c) for c in ("processed", "ok", "failed", "phishing")])


@query("sliding_detection_rate", sql(ALL, f"""SELECT w AS start_minute, {I('count(*) FILTER (success)')} AS ok, {I('count(*) FILTER (success AND y = 1)')} AS phishing FROM
  (SELECT success, y, ((start_us // 600000000) - unnest(range(6))) * 10 AS w FROM tr) GROUP BY 1"""))
def _(t):
    s = streams.sliding_detection_rate(landed_stream(t, docs(t)), "1 hour", "10 minutes", "100 days")
    u = updates(t, s, ["start"], "rate")
    return u.select(F.floor(F.unix_micros("start") / 60000000).alias("start_minute"), "ok", "phishing")


@query("session_traces", sql(ALL, """SELECT user_id, count(*) AS n_sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (
  SELECT user_id, sum(nw) OVER (PARTITION BY user_id ORDER BY tus, event_id) AS sid FROM (SELECT *, (tus - lag(tus) OVER (PARTITION BY user_id ORDER BY tus, event_id) >= 1800000000)::INT AS nw FROM v)) GROUP BY 1, 2) GROUP BY 1""")
       .replace("SELECT user_id, sum(nw)", "SELECT user_id, event_id, sum(coalesce(nw, 0))"))
def _(t):
    e = t.raw("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    # two far-off marker rows push the watermark past every real session, so that all of them close
    mark = t.spark.range(1).select((-F.lit(1)).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.timestamp_micros(F.lit(4102444800000000)).alias("ts"))
    path = scratch_path(t.spark, "landing")
    e.repartition(2).write.parquet(path)
    stream = streams.read_stream(t.spark, path, "user_id long, event_type string, ts timestamp", files_per_batch=1)
    out, chk = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "stream-checkpoint")
    s = streams.session_traces(stream, "30 minutes", "400 days")
    streams.run_available(s, out, chk)
    mark.write.mode("append").parquet(path)
    streams.run_available(s, out, chk)
    d = t.spark.read.schema(s.schema).parquet(out)
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("longest"))


@query("query_history_stream", sql(RUNS, f"SELECT query, count(*) AS runs, {I('sum(found)')} AS total_found, {R('avg(toxicity)')} AS avg_toxicity FROM runs GROUP BY 1"))
def _(t):
    s = streams.query_history_stream(landed_stream(t, land(runs(t).select("query", "found", "toxicity"), "runs")))
    return updates(t, s, ["query"], "history")


@query("dual_submission_stream", sql(ALL, """SELECT trace_id, count(*) AS n_resubmits FROM (SELECT trace_id, step, lag(step, 1) OVER w AS p1, lag(step, 2) OVER w AS p2 FROM (
  SELECT trace_id, tus, event_id, CASE event_type WHEN 'submit' THEN 'S' WHEN 'screenshot' THEN 'E' ELSE CASE WHEN url_after <> url_before THEN 'A' ELSE '-' END END AS step FROM ev)
  WHERE step <> '-' WINDOW w AS (PARTITION BY trace_id ORDER BY tus, event_id)) WHERE step = 'S' AND p1 = 'E' AND p2 = 'S' GROUP BY 1"""))
def _(t):
    step = (F.when(F.col("event_type") == "submit", "S").when(F.col("event_type") == "screenshot", "E")
            .when(F.col("url_after") != F.col("url_before"), "A").otherwise("-"))
    e = t.ev.select("trace_id", "tus", "event_id", step.alias("step")).filter("step <> '-'")
    path, out, chk = (scratch_path(t.spark, n) for n in ("landing", "resubmits", "stream-checkpoint"))
    # events of a trace lie in any file and order; a far-off marker row then pushes the watermark past all of them
    e.repartition(3, F.xxhash64("event_id")).write.parquet(path)
    s = streams.dual_submission_stream(streams.read_stream(t.spark, path, "trace_id long, tus long, event_id long, step string", files_per_batch=1), "400 days")
    streams.run_available(s, out, chk)
    t.spark.range(1).select((-F.lit(1)).cast("long").alias("trace_id"), F.lit(4102444800000000).cast("long").alias("tus"), F.lit(-1).cast("long").alias("event_id"),
                            F.lit("-").alias("step")).write.mode("append").parquet(path)
    streams.run_available(s, out, chk)
    return t.spark.read.schema(s.schema).parquet(out).groupBy("trace_id").agg(F.max("n_resubmits").alias("n_resubmits"))
