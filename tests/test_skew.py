"""One trace holds a third of all rows: results stay exact and no window spans a whole trace."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tracegraph.functions import ordered
from tracegraph.operators import stats
from tracegraph.sources.adapter import time_slice


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(7, rng.randrange(600_000_000_000), i, f"u{rng.randrange(9)}") for i in range(2000)]
    rows += [(t, rng.randrange(600_000_000_000), 10_000 + t * 10 + j, f"u{j}") for t in range(100, 500) for j in range(10)]
    return spark.createDataFrame(rows, "trace_id long, tus long, event_id long, url string").persist()


def test_sequence_equals_plain_window(events):
    got = ordered.sequence(events, ["trace_id"], ["tus", "event_id"], time_slice(), "idx", {"prev": "url"}, {"head": "url"})
    w = Window.partitionBy("trace_id").orderBy("tus", "event_id")
    want = events.select("*", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.lag("url").over(w).alias("prev"),
                         F.first("url").over(w).alias("head"))
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))


def test_running_equals_plain_window(events):
    e = events.withColumn("one", F.lit(1))
    got = ordered.running(e, ["trace_id"], ["tus", "event_id"], time_slice(), {"n": "one"})
    w = Window.partitionBy("trace_id").orderBy("tus", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r[0]): r[1] for r in e.select("event_id", F.sum("one").over(w)).collect()}
    assert {r["event_id"]: r["n"] for r in got.collect()} == want


def test_event_windows_are_sliced(events):
    plan = ordered.sequence(events, ["trace_id"], ["tus", "event_id"], time_slice(), "idx", {"prev": "url"})._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line:
            assert "_slice" in line.split("windowspecdefinition", 1)[1]


def test_hot_fingerprint_is_an_aggregate(spark):
    from tracegraph.operators import dedup
    p = spark.range(3000).select(F.col("id").alias("trace_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("fingerprint"))
    d = dedup.dedup_traces(p)
    assert d.filter("is_unique = 1").count() == 2001
    assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_match_numpy(spark):
    import numpy as np
    rng = random.Random(5)
    v = [round(rng.random(), 3) for _ in range(501)] + [0.25] * 250
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = ordered.exact_percentiles(df, "v", {"a": 0.333, "b": 0.667, "c": 0.5}).first()
    for name, p in (("a", 33.3), ("b", 66.7), ("c", 50)):
        assert got[name] == pytest.approx(np.percentile(v, p))


def test_permuted_input_changes_nothing(events):
    a = ordered.sequence(events, ["trace_id"], ["tus", "event_id"], time_slice(), "idx", {"prev": "url"})
    b = ordered.sequence(events.orderBy(F.rand(1)).repartition(13), ["trace_id"], ["tus", "event_id"], time_slice(), "idx", {"prev": "url"})
    assert a.exceptAll(b.select(a.columns)).isEmpty()


def test_scores_at_one_end(spark):
    """Nine tenths of the scores crowd into a thousandth of the range; ranks and percentiles stay exact."""
    rows = [(i % 3 == 0, 0.999 + i * 1e-7 if i % 10 else i / 1000) for i in range(1000)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, score double")
    pos, neg = ([s for y, s in rows if bool(y) is v] for v in (True, False))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(stats.roc_auc(df.withColumn("k", F.lit(1)), ["k"]).first()["auc"] - auc) < 1e-9
    got = ordered.exact_percentiles(df, "score", {"a": 0.3, "b": 0.9}).first()
    want = np.percentile([s for _, s in rows], [30, 90])
    assert abs(got["a"] - want[0]) < 1e-12 and abs(got["b"] - want[1]) < 1e-12
    band = df.select("score").distinct()
    sizes = ordered.with_band(band, "score", 16).groupBy("_band").count().toPandas()["count"]
    assert sizes.max() < 4 * len(rows) / 16
