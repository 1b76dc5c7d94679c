"""Many linear models in one pass: penalised logistic regression of all folds and column sets together, and moments of all column pairs.

A Newton step needs one aggregate: every task turns its rows into the weighted cross products of each (column set, fold), and these are
added up. The driver solves small systems of (columns + 1) unknowns; it sees sums, never rows. A step that raises the loss is halved, so the
optimum is reached whatever the start, mostly in under ten passes over the data instead of one job per fold, set and iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tracegraph.operators import stats
from tracegraph.session import land

GROUPS = 64  # partial sums are added in this many groups first


def add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """From (k, part, v) the sum of the arrays v of every k; at most a handful of small arrays reach the driver."""
    def total(rows: pa.Table) -> pa.Table:
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(0)
        return pa.table({"k": rows["k"].slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    some = parts.groupBy("k", (F.col("part") % GROUPS).alias("g")).applyInArrow(lambda r: total(r), "k int, v array<double>")
    got = some.groupBy("k").applyInArrow(lambda r: total(r), "k int, v array<double>").toPandas()
    return {int(k): np.array(v, dtype=float) for k, v in zip(got["k"], got["v"])}


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _partial(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()),
                                       pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["k", "part", "v"])


def _scales(data: DataFrame, width: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of every column over the rows outside each fold (fold, column); a constant column has deviation 1."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {f: np.zeros(1 + 2 * width) for f in range(folds)}
        for batch in batches:
            x, fold = _rows(batch, width), batch.column("fold").to_numpy()
            for f in range(folds):
                own = x[fold == f]
                out[f] += np.concatenate([[len(own)], own.sum(0), (own * own).sum(0)])
        yield _partial(out)

    got = add_up(data.mapInArrow(sums, "k int, part int, v array<double>"))
    own = np.stack([got.get(f, np.zeros(1 + 2 * width)) for f in range(folds)])
    rest = own.sum(0) - own
    n = np.maximum(rest[:, :1], 2)
    mean = rest[:, 1:width + 1] / n
    deviation = np.sqrt(np.maximum(rest[:, width + 1:] - n * mean * mean, 0) / (n - 1))
    return mean, np.where(deviation > 1e-9 * (1 + np.abs(mean)), deviation, 1.0)


def out_of_fold(df: DataFrame, sets: dict[str, list[str]], folds: int = 10, c: float = 1.0, rounds: int = 1000, tolerance: float = 1e-9,
                key: str = "trace_id") -> DataFrame:
    """Rows (key, y, fold, method, score, pred): every row scored for every column set by the model that did not see its fold.

    Classes are balanced by weight and columns standardised by the training rows; ``c`` is the inverse penalty of the summed weighted loss,
    and the constant is not penalised.
    """
    columns = list(dict.fromkeys(x for cs in sets.values() for x in cs))
    width, names = len(columns), list(sets)
    at = {s: np.array([columns.index(x) for x in cs]) for s, cs in sets.items()}
    ready = stats.balanced_weights(stats.stratified_folds(df.select(key, "y", *columns), folds, key=key))
    data = land(ready.select(key, F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), "weight",
                             F.array(*[F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in columns]).alias("x")), "linear")
    mean, deviation = _scales(data, width, folds)
    # weights of the sets go by scaled columns, the constant first
    beta = {(s, f): np.zeros(len(at[s]) + 1) for s in names for f in range(folds)}
    step = {m: np.zeros_like(b) for m, b in beta.items()}
    loss = dict.fromkeys(beta, np.inf)
    open_ = set(beta)
    number = {m: i for i, m in enumerate(beta)}

    def scaled(x: np.ndarray, s: str, f: int) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x[:, at[s]] - mean[f, at[s]]) / deviation[f, at[s]]]

    for _ in range(rounds):
        now = {m: beta[m] for m in open_}

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            out = {number[m]: np.zeros(1 + len(b) + len(b) ** 2) for m, b in now.items()}
            for batch in batches:
                x, fold, y, w = _rows(batch, width), *(batch.column(k).to_numpy() for k in ("fold", "y", "weight"))
                for (s, f), b in now.items():
                    seen = fold != f
                    z = scaled(x[seen], s, f)
                    t = np.clip(z @ b, -35, 35)
                    p = 1 / (1 + np.exp(-t))
                    lost = (w[seen] * (np.logaddexp(0, t) - y[seen] * t)).sum()
                    out[number[s, f]] += np.concatenate([[lost], z.T @ (w[seen] * (y[seen] - p)), ((z * (w[seen] * p * (1 - p))[:, None]).T @ z).ravel()])
            yield _partial(out)

        got = add_up(data.mapInArrow(sums, "k int, part int, v array<double>"))
        for m in sorted(open_):
            b, v = beta[m], got.get(number[m])
            if v is None:
                open_.discard(m)
                continue
            n = len(b)
            ridge = np.diag(np.r_[0.0, np.full(n - 1, 1.0 / c)])
            total = v[0] + b @ ridge @ b / 2
            if total > loss[m] + 1e-9 * abs(loss[m]) and np.abs(step[m]).max() > tolerance:
                step[m] = step[m] / 2
                beta[m] = b - step[m]
                continue
            loss[m] = total
            slope = v[1:1 + n] - ridge @ b
            step[m] = np.linalg.lstsq(v[1 + n:].reshape(n, n) + ridge, slope, rcond=None)[0]
            beta[m] = b + step[m]
            # where all rows are of one class the constant grows without end, but what is left to gain vanishes
            if np.abs(step[m]).max() < tolerance or slope @ step[m] < tolerance * (1e-3 + total):
                open_.discard(m)
        if not open_:
            break

    schema = data.select(key, "y", "fold", F.lit("").alias("method"), F.lit(0.0).alias("score"), F.lit(0).alias("pred")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _rows(batch, width), batch.column("fold").to_numpy()
            for s in names:
                p = np.zeros(len(x))
                for f in range(folds):
                    p[fold == f] = 1 / (1 + np.exp(-np.clip(scaled(x[fold == f], s, f) @ beta[s, f], -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("y"), batch.column("fold"), pa.array([s] * len(x)), pa.array(p),
                                                  pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return data.mapInArrow(score, schema)


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation of every two columns; NaN where one is constant or there are no rows."""
    width = len(columns)
    data = land(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), "moments")
    middle = data.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), (F.min("v") == F.max("v")).alias("flat")).toPandas()
    mean, flat = np.zeros(width), np.ones(width, bool)
    mean[middle["i"]], flat[middle["i"]] = middle["m"].fillna(0.0), middle["flat"].fillna(True).astype(bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            z = _rows(batch, width) - mean
            out += z.T @ z
        yield _partial({0: out.ravel()})

    got = add_up(data.mapInArrow(sums, "k int, part int, v array<double>")).get(0, np.zeros(width * width)).reshape(width, width)
    size = np.sqrt(np.diag(got))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat[:, None] | flat[None, :], np.nan, got / np.outer(size, size))
