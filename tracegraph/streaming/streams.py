"""Streaming jobs: candidates, verdicts, counters, sessions, keyed state.

Sources are landing folders; sinks are tables. Every query takes its checkpoint
folder, so a restart continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tracegraph.operators import domains, graph, rules, views
from tracegraph.session import land
from tracegraph.sources import traces

WATERMARK = "2 hours"


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything landed so far into a parquet table and stop."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    q.awaitTermination()


def candidate_stream(feed: DataFrame, threshold: float = 0.2, watermark: str = WATERMARK) -> DataFrame:
    """First sight of each domain within the watermark, scored; low scores dropped."""
    fresh = feed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["domain"])
    return domains.domain_score(fresh).filter(F.col("score") >= threshold).withColumn("reasons", F.array_join("reasons", "; "))


def graph_verdicts(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Trace documents (with a hash) judged by their interaction graphs: hash, prediction, confidence, risk_factors, method.

    Nodes, edges and graph features are built from the documents. A fitted pipeline scores all thirty features; without one the
    rules do, which need no path features.
    """
    flat = traces.trace_flatten(docs)
    nodes = land(graph.itg_nodes(flat["tr"], flat["ev"], flat["rd"]), "batch-nodes")
    edges = land(graph.itg_edges(flat["ev"], flat["rd"]), "batch-edges")
    if model is None:
        out = rules.heuristic_verdict(views.local_view(nodes, edges))
        return out.select(F.col("trace_id").alias("hash"), F.col("is_phishing").alias("prediction"), "confidence", "risk_factors", "method")
    out = model.transform(views.itg_view(nodes, edges))
    share = vector_to_array("probability")[1]
    hit = share > 0.5
    return out.select(F.col("trace_id").alias("hash"), hit.cast("int").alias("prediction"), F.when(hit, share).otherwise(1 - share).alias("confidence"),
                      F.lit("").alias("risk_factors"), F.lit("model").alias("method"))


def verdict_batches(spark: SparkSession, classify: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that adds verdicts by hash and routes each batch by source and verdict.

    A hash that another batch has stored already is left out; a batch that is run again overwrites its own folder and no other.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        docs = batch.dropDuplicates(["hash"])
        if exists(spark, path):
            stored = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") != batch_id).select("hash").distinct()
            docs = docs.join(stored, "hash", "left_anti")
        docs = land(docs, "batch-documents")
        verdict = F.when(F.col("prediction") == 1, "phishing").when(F.col("prediction") == 0, "benign").otherwise("other")
        out = docs.select("hash", "url", "source").join(classify(docs), "hash", "left").withColumn("verdict", verdict)
        out.write.mode("overwrite").partitionBy("source", "verdict").parquet(f"{path}/batch={batch_id}")

    return write


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf).exists(target)


def trace_stream_verdict(docs: DataFrame, path: str, checkpoint: str, classify: Callable[[DataFrame], DataFrame] = graph_verdicts) -> StreamingQuery:
    return docs.writeStream.foreachBatch(verdict_batches(docs.sparkSession, classify, path)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def promote_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Successful documents appended by label; the file source hands each file over exactly once."""
    return docs.filter("success").writeStream.format("parquet").partitionBy("label").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def counters() -> list:
    return [F.count(F.lit(1)).alias("processed"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
            F.count_if(F.col("success") & (F.col("y") == 1)).alias("phishing")]


def cycle_stats_stream(docs: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    w = docs.withWatermark("ts", watermark).groupBy(F.window("ts", window)).agg(*counters())
    return w.select(F.col("window.start").alias("start"), *[c for c in w.columns if c != "window"])


def sliding_detection_rate(docs: DataFrame, length: str = "1 hour", step: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    w = docs.withWatermark("ts", watermark).groupBy(F.window("ts", length, step)).agg(*counters())
    return w.select(F.col("window.start").alias("start"), "ok", "phishing",
                    F.try_divide(F.col("phishing").cast("double"), F.col("ok")).alias("detection_rate"))


def session_traces(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Raw events of a user grouped into sessions that end after a quiet gap.

    Sessions are merged inside each task before they are shuffled, so a user with very many events sends few rows.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    s = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_submits"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.drop("session_window")


def combined(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``sums`` added up by ``keys`` inside every Arrow batch, before a keyed operator shuffles: a hot key sends one row per batch."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(keys, as_index=False, dropna=False, sort=False)[sums].sum()[keys + sums]

    rows = rows.select(*keys, *sums)
    return rows.mapInPandas(add, rows.schema)


class SeenDomains(StatefulProcessor):
    """Lets a key through at its first sight; the memory of it expires ``ttl_ms`` after the last one."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = sum(int(r["n"].sum()) for r in rows)
        old = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((old + total,))
        if old == 0:
            yield pd.DataFrame({"domain": [key[0]], "first_batch": [total]})

    def close(self) -> None:
        pass


def seen_state(feed: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    counts = combined(feed.select("domain", F.lit(1).cast("long").alias("n")), ["domain"], ["n"])
    return counts.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=SeenDomains(ttl_ms), outputStructType="domain string, first_batch long", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class QueryHistory(StatefulProcessor):
    """Runs, finds and mean toxicity per query; three numbers are kept, for ``ttl_ms`` after the last run."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "runs long, found long, toxicity double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, found, toxicity = self.state.get() if self.state.exists() else (0, 0, 0.0)
        for r in rows:
            runs, found, toxicity = runs + int(r["runs"].sum()), found + int(r["found"].sum()), toxicity + float(r["toxicity"].sum())
        self.state.update((runs, found, toxicity))
        yield pd.DataFrame({"query": [key[0]], "runs": [runs], "total_found": [found], "avg_toxicity": [toxicity / runs]})

    def close(self) -> None:
        pass


def query_history_stream(runs: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    sums = runs.select("query", F.lit(1).cast("long").alias("runs"), F.col("found").cast("long").alias("found"), F.col("toxicity").cast("double").alias("toxicity"))
    return combined(sums, ["query"], ["runs", "found", "toxicity"]).groupBy("query").transformWithStateInPandas(
        statefulProcessor=QueryHistory(ttl_ms), outputStructType="query string, runs long, total_found long, avg_toxicity double",
        outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


class DualSubmission(StatefulProcessor):
    """Submit, error, submit in event order per site.

    Events wait in a list until the watermark has passed them; a timer then releases what is due, in order. The last two steps are
    kept until a session has been quiet for ``session_us``; then nothing of the site is left.
    """

    def __init__(self, session_us: int):
        self.session_us = session_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "tus long, event_id long, step string")
        self.steps = handle.getValueState("steps", "a string, b string, last long, found long")

    def _call_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in rows:
            self.waiting.appendList([(int(a), int(b), c) for a, b, c in zip(r["tus"], r["event_id"], r["step"])])
            self._call_at(int(r["tus"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        later = [x for x in rows if x[0] > now]
        a, b, last, found = self.steps.get() if self.steps.exists() else ("", "", None, 0)
        before = found
        for tus, _, step in sorted(x for x in rows if x[0] <= now):
            if last is not None and tus - last > self.session_us:
                a, b, found, before = "", "", 0, 0
            found += int(step == "S" and b == "E" and a == "S")
            a, b, last = b, step, tus
        if later:
            self.waiting.put(later)
            self._call_at(min(later)[0])
        elif rows:
            self.waiting.clear()
        if last is not None and last + self.session_us < now and not later:
            self.steps.clear()
        elif last is not None:
            self.steps.update((a, b, last, found))
            self._call_at(last + self.session_us + 1000)
        if found > before:
            yield pd.DataFrame({"trace_id": [key[0]], "n_resubmits": [found]})

    def close(self) -> None:
        pass


def dual_submission_stream(events: DataFrame, watermark: str = WATERMARK, session_us: int = 8 * 86_400_000_000) -> DataFrame:
    """Sites whose events show a second submission after an error, with their number in the session so far.

    ``events`` (trace_id, tus, event_id, step) may come in any order within the watermark; what comes later than that is dropped.
    """
    timed = events.withColumn("ts", F.timestamp_micros("tus")).withWatermark("ts", watermark)
    return timed.groupBy("trace_id").transformWithStateInPandas(
        statefulProcessor=DualSubmission(session_us), outputStructType="trace_id long, n_resubmits long", outputMode="Append", timeMode="EventTime")
