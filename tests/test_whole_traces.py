"""Steps that the trace tables share: ordinary traces are ordered, measured and counted in one pass, with the results of the general way."""

import random

import graphs as g
import pytest
from pyspark.sql import functions as F

from test_small_traces import many
from tracegraph.functions import ordered
from tracegraph.operators import graph, paths, views
from tracegraph.sources import adapter
from tracegraph.sources.adapter import Tables, time_slice

DIR = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_keys_take_one_exchange_and_large_ones_slices(spark):
    rng = random.Random(3)
    rows = [(7, rng.randrange(600_000_000_000), i, f"u{rng.randrange(9)}") for i in range(500)]
    rows += [(t, rng.randrange(600_000_000_000), 10_000 + t * 10 + j, f"u{j}") for t in range(100, 200) for j in range(10)]
    df = spark.createDataFrame(rows, "trace_id long, tus long, event_id long, url string")
    ask = (["trace_id"], ["tus", "event_id"], time_slice())
    add = ("idx", {"prev": "url"}, {"head": "url"})
    want = ordered.sequence(df, *ask, *add)
    plain = ordered.sequence_by_size(df, *ask, None, *add)
    mixed = ordered.sequence_by_size(df, *ask, spark.createDataFrame([(7,)], "trace_id long"), *add)
    order = sorted(want.columns)
    assert sorted(map(str, plain.select(order).collect())) == sorted(map(str, want.select(order).collect())) == sorted(map(str, mixed.select(order).collect()))
    assert exchanges(plain) == 1


def test_tables_do_not_depend_on_the_bound(spark, monkeypatch):
    usual, sliced = Tables(spark, DIR), Tables(spark, DIR)
    assert usual.large is None
    monkeypatch.setattr(adapter, "WHOLE", 3)
    assert sliced.large is not None
    for name in ("ev", "rd", "seq", "nodes", "edges"):
        a, b = getattr(usual, name), getattr(sliced, name)
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).isEmpty()


def test_shapes_of_the_walk_equal_the_joins(spark):
    n, e = g.tables(spark, many(5))
    want = {r["trace_id"]: r for r in graph.degree_stats(n, e).join(graph.clustering(n, e), "trace_id").collect()}
    for small in (paths.SMALL, 8, 0):
        got = {r["trace_id"]: r for r in paths.path_metrics(n, e, small=small, shapes=True).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert [r[c] for c in paths.SHAPES] == pytest.approx([want[k][c] for c in paths.SHAPES], abs=1e-12)


def test_graph_view_with_shapes_joins_no_edges(spark):
    t = Tables(spark, DIR)
    got, want = views.itg_view(t.nodes, t.edges, t.shapes), views.itg_view(t.nodes, t.edges, t.paths)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "src" not in plan and "dst" not in plan
    rounded = lambda df: df.select("trace_id", *[F.round(c, 9).alias(c) for c in df.columns[1:]])
    assert rounded(got).exceptAll(rounded(want)).isEmpty() and got.count() == want.count()


def test_requests_of_odd_traces(spark):
    tr = spark.createDataFrame([(1, "http://a.com/x"), (2, None), (3, "http://b.com"), (4, "")], "trace_id long, final_url string")
    row = lambda t, u, c: (t, u, "script", 200, c, 5)
    rq = spark.createDataFrame([row(1, "http://a.com/1", "text/css"), row(1, "http://cdn.x/1", "text/css; q"), row(1, "nothing", None), row(1, None, ""),
                                row(2, "http://a.com/1", "a"), row(4, "http://b.com/1", "a"), row(4, "http://b.com/2", "b"), row(9, "http://b.com/2", "b")],
                               "trace_id long, url string, resource_type string, status int, content_type string, tus long")
    stats = views.request_stats(tr, rq)
    got = {r["trace_id"]: (r["n"], r["unique_domains"], r["external"], r["cdn"], r["content_type_diversity"]) for r in stats.collect()}
    assert got == {1: (4, 2, 1, 1, 1), 2: (1, 1, 0, 0, 1), 3: (0, 0, 0, 0, 0), 4: (2, 1, 2, 0, 2)}
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
