"""Labelled samples of bounded size, and the logistic curve that turns features into scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.llm.common import fresh, hash60, held_out, least_rows


def training_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """One row (key, y) per labelled document outside the held-out fold; of labels that disagree the larger counts.

    Rows without id or label say nothing.
    """
    rows = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y"))
    return rows.filter(F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))


def sample(train: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``train``, those with the least seeded hash."""
    place = fresh(train.columns, "_place")
    near = least_rows(train.withColumn(place, hash60(F.lit(str(seed)), F.col("key").cast("string"))), place, rows)
    return near.orderBy(place, "key").limit(rows).drop(place)


def for_curve() -> Column:
    """A quarter of the training keys; they fit the curve and are not learned from otherwise."""
    return hash60(F.lit("curve"), F.col("key").cast("string")) % 4 == 0


def texts_of(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``chosen`` rows, a sample of bounded size, with their text; of documents that repeat a key the least text."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(chosen), "key").groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def fit_curve(measured: DataFrame, width: int) -> Logistic:
    """The curve of (y, x) rows, a bounded sample; they are put in one order here, so that reruns agree to the last digit."""
    rows = measured.toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, width)
    y = rows["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    return Logistic.fit(x[order], y[order])


def fit_whole_curve(measured: DataFrame, width: int, ridge: float = 1e-2, rounds: int = 50) -> Logistic:
    """``Logistic.fit`` of all rows of the landed table (y, x), however many: a step is one aggregate, of which the driver sees one row of sums.

    Numbers are rounded after the last step, so that the order of sums does not show.
    """
    columns = [F.col("x")[i] for i in range(width)]
    n, ones, *moments = measured.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    if ones in (0, n):
        return Logistic.fit(np.zeros((n, width)), np.full(n, float(ones > 0)))
    mean, scale = np.round(moments[:width], 12), np.round(moments[width:], 12) + 1e-9
    z = [F.lit(1.0), *[(c - float(m)) / float(s) for c, m, s in zip(columns, mean, scale)]]
    pairs, w = [(i, j) for i in range(width + 1) for j in range(i + 1)], np.zeros(width + 1)
    for _ in range(rounds):
        t = sum((c * float(b) for c, b in zip(z, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.least(F.greatest(t, F.lit(-30.0)), F.lit(30.0))))
        rows = measured.select("y", F.array(*z).alias("z"), p.alias("p"))
        v = F.col("p") * (1 - F.col("p")) + 1e-9
        got = rows.agg(*[F.sum(F.col("z")[i] * (F.col("y") - F.col("p"))) for i in range(width + 1)],
                       *[F.sum(v * F.col("z")[i] * F.col("z")[j]) for i, j in pairs]).first()
        curved = ridge * np.eye(width + 1)
        for (i, j), x in zip(pairs, got[width + 1:]):
            curved[i, j] += x
            curved[j, i] = curved[i, j]
        step = np.linalg.solve(curved, np.array(got[:width + 1]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, np.round(w, 9))


@dataclass(frozen=True)
class Logistic:
    """P(y = 1) of standardised features; a fit without both classes gives the share of ones (one half without rows)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> Logistic:
        n = x.shape[1]
        if len(y) == 0 or y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            return Logistic(np.zeros(n), np.ones(n), np.array([np.log(share / (1 - share)), *[0.0] * n]))
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros(n + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            v = p * (1 - p) + 1e-9
            step = np.linalg.solve((z * v[:, None]).T @ z + ridge * np.eye(n + 1), z.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return Logistic(mean, scale, w)
