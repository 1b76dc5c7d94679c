"""Small traces are walked in tasks: the same metrics as by joins, no rows of pairs."""

import random

import graphs as g
import pytest

from tracegraph.operators import paths


def many(seed, count=40):
    rng, out = random.Random(seed), dict(g.ALL)
    for k in range(10, 10 + count):
        names = ["u0"] + [f"{rng.choice('uabs')}{i}" for i in range(1, rng.randrange(2, 24))]
        links = {(rng.choice(names), rng.choice(names)): rng.randrange(1, 4) for _ in range(rng.randrange(40))}
        out[k] = (names, [(a, b, w) for (a, b), w in links.items()])
    return out


def test_both_ways_agree(spark):
    n, e = g.tables(spark, many(4))
    near, far = ({r["trace_id"]: r.asDict() for r in paths.path_metrics(n, e, small=s).collect()} for s in (paths.SMALL, 0))
    mixed = {r["trace_id"]: r.asDict() for r in paths.path_metrics(n, e, small=8).collect()}
    assert near.keys() == far.keys() == mixed.keys() and len(near) == 48
    for k in near:
        assert near[k] == pytest.approx(far[k], abs=1e-12) and mixed[k] == pytest.approx(far[k], abs=1e-12)
    a, b = (sorted(map(tuple, paths.distance_histogram(n, e, small=s).collect())) for s in (paths.SMALL, 0))
    assert a == b


def test_small_traces_leave_no_pairs(spark, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("pairs of small traces are spread over rows")

    monkeypatch.setattr(paths, "all_pairs", never)
    n, e = g.tables(spark, {k: (["u0"] + [f"a{i}" for i in range(100)], [("u0", "a0", 1)] + [(f"a{i}", f"a{i + 1}", 1) for i in range(99)]) for k in range(20)})
    got = paths.path_metrics(n, e).collect()
    assert len(got) == 20 and {(r["diameter"], r["max_redirect_depth"], r["n_nodes"]) for r in got} == {(100, 100, 101)}
    assert paths.distance_histogram(n, e).count() == 20 * 101
