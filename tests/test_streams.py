"""Keyed streams and verdicts: restart, hot keys, replay."""

from pyspark.sql import functions as F

from tracegraph.session import scratch_path
from tracegraph.streaming import streams


class Feed:
    """A landing folder to which files are added one at a time, and a query that is restarted from its checkpoint."""

    def __init__(self, spark, schema, build):
        self.spark, self.schema, self.build = spark, schema, build
        self.path, self.out, self.chk = (scratch_path(spark, n) for n in ("feed", "out", "chk"))

    def send(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        df = self.build(streams.read_stream(self.spark, self.path, self.schema, files_per_batch=1))
        streams.run_available(df, self.out, self.chk)
        return [r.asDict() for r in self.spark.read.schema(df.schema).parquet(self.out).collect()]


def test_restart_keeps_what_was_seen(spark):
    feed = Feed(spark, "domain string", lambda s: streams.seen_state(s.select("domain")))
    first = feed.send([("a",)] * 1000 + [("b",)])
    assert sorted((r["domain"], r["first_batch"]) for r in first) == [("a", 1000), ("b", 1)]
    assert len(feed.send([("a",), ("b",)], [("c",)])) == 3


def test_hot_keys_are_combined(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("n")).coalesce(2)
    got = streams.combined(rows, ["k"], ["n"]).groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    assert sum(r.n for r in got) == 10_000 and all(r.rows <= 4 for r in got)


def test_verdicts_come_once_and_a_batch_can_be_repeated(spark):
    path = scratch_path(spark, "verdicts")
    judge = lambda d: d.select("hash", (F.length("hash") % 2).alias("prediction"))
    write = streams.verdict_batches(spark, judge, path)
    docs = lambda *hs: spark.createDataFrame([(h, f"u/{h}", "feed") for h in hs], "hash string, url string, source string")
    stored = lambda: sorted((r.batch, r.hash, r.verdict) for r in spark.read.parquet(path).collect())
    write(docs("a", "bb", "a"), 0)
    write(docs("bb", "ccc"), 1)
    want = [(0, "a", "phishing"), (0, "bb", "benign"), (1, "ccc", "phishing")]
    assert stored() == want
    write(docs("bb", "ccc"), 1)
    write(docs("a", "bb", "a"), 0)
    assert stored() == want
