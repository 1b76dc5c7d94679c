"""Metrics against direct computation."""

import random

import pytest

from tracegraph.operators import learn, stats


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.4)
        s = round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)
        rows.append((i, y, i % 4, s, int(s >= 0.5), rng.gauss(y, 1), rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "trace_id long, y int, fold int, score double, pred int, a double, b double").persist()


def test_auc_with_ties(scores):
    rows, df = scores
    pos, neg = [r[3] for r in rows if r[1]], [r[3] for r in rows if not r[1]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert stats.roc_auc(df, []).first()["auc"] == pytest.approx(want)


def test_binary_metrics(scores):
    rows, df = scores
    m = stats.binary_metrics(df, []).first()
    tp = sum(r[1] and r[4] for r in rows)
    assert m["tp"] == tp and m["f1"] == pytest.approx(2 * tp / (sum(r[1] for r in rows) + sum(r[4] for r in rows)))


def test_folds_are_stratified(scores):
    _, df = scores
    f = stats.stratified_folds(df.drop("fold"), 10)
    counts = {(r["y"], r["fold"]): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        per = [counts[(y, k)] for k in range(10)]
        assert max(per) - min(per) <= 1


def test_wilcoxon(spark):
    pairs = [(1.0, 0.5), (0.7, 0.9), (0.6, 0.6), (0.9, 0.4), (0.3, 0.1), (0.2, 0.4)]
    df = spark.createDataFrame([("m", a, b) for a, b in pairs], "method string, a double, b double")
    r = stats.wilcoxon_signed_rank(df, ["method"]).first()
    # differences .5 -.2 .5 .2 -.2 -> ranks .2 x3 = 2, .5 x2 = 4.5
    assert (r["w_plus"], r["w_minus"], r["statistic"]) == (11.0, 4.0, 4.0)


def test_cross_validation_learns(scores):
    _, df = scores
    m = learn.cross_validate(df.drop("fold", "score", "pred"), ["a", "b"], learn.lr(), 3).first()
    assert m["auc"] > 0.65 and all(0 <= m[k] <= 1 for k in ("accuracy", "precision", "recall", "f1"))


def test_every_classifier_yields_metrics(scores):
    _, df = scores
    d = df.drop("fold", "score", "pred")
    cases = {"gbm": learn.gbm(3, 3), "rf": learn.rf(5, 5), "mlp": learn.mlp(8, rounds=20), "svm": learn.svm(10.0, 10)}
    for r in learn.compare(d, {k: (["a", "b"], v) for k, v in cases.items()}, 2).collect():
        assert 0 <= r["accuracy"] <= 1 and 0 <= r["f1"] <= 1
