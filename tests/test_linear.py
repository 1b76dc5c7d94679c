"""One-pass linear models against a plain optimiser, and moments against numpy."""

import numpy as np
import pytest

from tracegraph.operators import linear, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1000] + [0, 5, 1, 1e5]
    x[:, 3] += 900 * x[:, 0]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=300) > 0.8).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i]), 7.0) for i in range(300)]
    return spark.createDataFrame(rows, "trace_id long, y int, a double, b double, c double, d double, flat double").persist()


def plain(x, y, w, c):
    z = np.c_[np.ones(len(x)), x]
    b, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ b)
    return b


@pytest.mark.parametrize("c", [1.0, 100.0])
def test_out_of_fold_scores(spark, table, c):
    sets = {"two": ["a", "b"], "all": ["a", "b", "c", "d", "flat"]}
    got = linear.out_of_fold(table, sets, 3, c).toPandas()
    rows = stats.balanced_weights(stats.stratified_folds(table, 3)).toPandas()
    assert len(got) == 600 and set(got["pred"]) <= {0, 1}
    for name, cols in sets.items():
        mine = got[got["method"] == name].set_index("trace_id")["score"]
        for f in range(3):
            tr, te = rows[rows["fold"] != f], rows[rows["fold"] == f]
            mean, dev = tr[cols].mean(), tr[cols].std().replace(0, 1)
            b = plain(((tr[cols] - mean) / dev).to_numpy(), tr["y"].to_numpy(), tr["weight"].to_numpy(), c)
            want = 1 / (1 + np.exp(-(b[0] + ((te[cols] - mean) / dev).to_numpy() @ b[1:])))
            assert mine.loc[te["trace_id"]].to_numpy() == pytest.approx(want, abs=1e-6)


def test_separable_classes_and_one_class(spark):
    rows = [(i, i % 2, float(i % 2) * 50 + i / 100) for i in range(40)]
    got = linear.out_of_fold(spark.createDataFrame(rows, "trace_id long, y int, a double"), {"s": ["a"]}, 4).toPandas()
    assert (got["pred"] == got["y"]).all()
    only = linear.out_of_fold(spark.createDataFrame([(i, 1, float(i)) for i in range(10)], "trace_id long, y int, a double"), {"s": ["a"]}, 2).toPandas()
    assert len(only) == 10 and only["score"].between(0, 1).all()


def test_correlations(table):
    cols = ["a", "b", "c", "d", "flat"]
    got, x = linear.correlations(table, cols), table.toPandas()[cols[:4]].to_numpy()
    assert got[:4, :4] == pytest.approx(np.corrcoef(x.T)) and np.isnan(got[4]).all()


def test_naive_bayes(spark, table):
    got = stats.naive_bayes(table, {"v": ["a", "b"], "w": ["d"]}, 3).toPandas()
    rows = stats.stratified_folds(table, 3).toPandas()
    for view, cols in {"v": ["a", "b"], "w": ["d"]}.items():
        mine = got[got["view"] == view].set_index("trace_id")["llr"]
        for f in range(3):
            tr, te = rows[rows["fold"] != f], rows[rows["fold"] == f]
            want = 0
            for c in cols:
                part = {k: (tr.loc[tr["y"] == k, c].mean(), tr.loc[tr["y"] == k, c].var(ddof=0) + 1e-6) for k in (0, 1)}
                lp = {k: -(np.log(v) + (te[c] - m) ** 2 / v) / 2 for k, (m, v) in part.items()}
                want = want + lp[1] - lp[0]
            assert mine.loc[te["trace_id"]].to_numpy() == pytest.approx(want.to_numpy(), rel=1e-5, abs=1e-5)


def test_bands(spark, monkeypatch):
    from tracegraph.functions import ordered
    monkeypatch.setattr(ordered, "BAND_ROWS", 10)
    df = spark.createDataFrame([(float(i % 97) if i else None,) for i in range(500)], "v double")
    rows = sorted(((r.v is not None, r.v or 0.0), r._band) for r in ordered.with_band(df, "v").collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len({b for _, b in rows}) > 5
