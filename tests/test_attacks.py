"""Transformed copies of the positive traces are built in one pass and equal those built one by one."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from tracegraph.functions import ordered
from tracegraph.operators import attacks, graph, learn, perturb, views
from tracegraph.plans.registry import tables

DIR = "/root/testdata/sf0.001"


def test_one_pass(spark, monkeypatch):
    t = tables(spark, DIR)
    tr, ev = t.tr.filter("success AND y = 1"), t.ev.join(t.tr.filter("success AND y = 1").select("trace_id"), "trace_id", "left_semi")
    alone = {name: {r["trace_id"]: r for r in views.itg_view(graph.itg_nodes(a, e, t.rd).join(a.select("trace_id"), "trace_id", "left_semi"), graph.itg_edges(e, t.rd)).collect()}
             for name, (a, e) in {"combined_structural": (tr, perturb.combined_structural(tr, ev)),
                                  "url_camouflage": (perturb.url_camouflage(tr), attacks.rooted(perturb.url_camouflage(tr), ev))}.items()}
    t.itg, t.views
    calls, build = [], graph.itg_nodes
    monkeypatch.setattr(graph, "itg_nodes", lambda *a: calls.append(1) or build(*a))

    def never(*args, **kwargs):
        raise AssertionError("small traces are ordered in slices")

    monkeypatch.setattr(ordered, "sequence", never)
    got = attacks.attacked_itg(t, attacks.attacked_tables(t)).collect()
    assert len(calls) == 1 and len(got) == tr.count() * len(attacks.TRACES)
    for name, want in alone.items():
        code = attacks.TRACES.index(name) + 1
        mine = {r["trace_id"] // attacks.CODES: r for r in got if r["trace_id"] % attacks.CODES == code}
        assert mine.keys() == want.keys() and len(mine) > 5
        for k in mine:
            assert tuple(mine[k])[1:] == pytest.approx(tuple(want[k])[1:], abs=1e-9)


def test_report_counts(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "trace_id long, y int")
    rows = [("m", 1, 0, 1), ("m", 2, 0, 0), ("m", 3, 0, 0), ("m", 4, 0, 1), ("m", 1, 1, 0), ("m", 2, 1, 1)]
    got = attacks.report(spark.createDataFrame(rows, "model string, trace_id long, code int, pred int"), labels, ["clean", "a"])
    got = {r["attack"]: r for r in got.collect()}
    assert [got["clean"][c] for c in ("accuracy", "f1", "detected", "evaded")] == [0.5, 0.5, 1, 0]
    assert [got["a"][c] for c in ("accuracy", "f1", "detected", "evaded", "evasion_rate")] == [0.5, 0.5, 1, 1, 1.0]


def test_every_transform_and_model(spark, monkeypatch):
    asked = {}

    def take(rows, cases):
        asked["codes"] = {r[0] for r in rows.filter("fold = 0").select((F.col("trace_id") % attacks.CODES).cast("int")).distinct().collect()}
        asked["cases"] = {m: (len(c), learner.params["trees"]) for m, (c, learner) in cases.items()}
        return rows.select(F.lit("full").alias("method"), "trace_id", F.lit(1).alias("pred"))

    monkeypatch.setattr(learn, "train_and_score", take)
    t = tables(spark, DIR)
    a = attacks.attacked_tables(t)
    attacks.model_verdicts(t, a, attacks.attacked_itg(t, a))
    assert asked["codes"] == set(range(14)) and len(attacks.NAMES) == 14 and {"split_forms", "combined", "mean_substitution"} <= set(attacks.NAMES)
    assert asked["cases"] == {"full": (125, 500), "non_url": (104, 500), "url": (21, 200), "itg": (42, 500)}
