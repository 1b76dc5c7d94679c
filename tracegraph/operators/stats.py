"""Folds, metrics, redundancy and significance, as aggregates over score tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import ordered
from tracegraph.functions.text import div
from tracegraph.session import land


# ------------------------------------------------------------------ folds
def stratified_rank(df: DataFrame, label: str = "y", key: str = "trace_id", seed: int = 42) -> DataFrame:
    """Position (``pos``) of each row in a seeded shuffle of its class, ranked in 4096 hash slices."""
    h = df.withColumn("_h", ordered.hash_order(seed, key))
    return ordered.sequence(h, [label], ["_h", key], F.substring("_h", 1, 3), "pos").drop("_h")


def fold_count(df: DataFrame, label: str = "y", most: int = 10) -> int:
    """max(2, min(most, size of the smaller class)); two counts reach the driver."""
    sizes = [r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(2, min(most, min(sizes)))


def stratified_folds(df: DataFrame, k: int = 10, label: str = "y", key: str = "trace_id", seed: int = 42) -> DataFrame:
    return stratified_rank(df, label, key, seed).withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos")


def stratified_split(df: DataFrame, train: float = 0.7, label: str = "y", key: str = "trace_id", seed: int = 42) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row per class
    ranked = stratified_rank(df, label, key, seed).join(F.broadcast(n), label)
    return ranked.withColumn("is_train", (F.col("pos") < F.round(F.col("_n") * train)).cast("int")).drop("pos", "_n")


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """n / (classes * class size) per row; the class table has one row per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_t", F.sum("_n").over(_all())).withColumn("_k", F.count(F.lit(1)).over(_all()))
    return df.join(F.broadcast(c.select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))), label)


def _all():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(1))  # over one row per class only


# ------------------------------------------------------------------ metrics
def binary_metrics(df: DataFrame, keys: list[str], label: str = "y", pred: str = "pred") -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    a = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
                              F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return a.select(*keys, "tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, keys: list[str], label: str = "y", score: str = "score", bands: int | None = None) -> DataFrame:
    """Area under the curve with half credit for ties, from running sums over distinct scores."""
    pairs = df.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                                           F.count_if(F.col(label) != 1).alias("neg"))
    r = ordered.running(ordered.with_band(pairs, "s", bands), keys, ["s"], F.col("_band"), {"below": "neg"}, inclusive=False)
    a = r.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"),
                             F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return a.select(*keys, F.when(F.col("p") * F.col("n") > 0, F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def fold_metric_summary(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over folds, NaN left out."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m).cast("double")), F.col(m))
        aggs += [F.avg(v).alias(m), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{m}_std")]
    return folds.groupBy(*keys).agg(*aggs)


def clean_vs_attacked(clean: DataFrame, attacked: DataFrame) -> DataFrame:
    return clean.select("trace_id", "y", F.col("pred").alias("clean_pred")).join(
        attacked.select("trace_id", F.col("pred").alias("attacked_pred")), "trace_id")


def evasion_rate(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    found = (F.col("y") == 1) & (F.col("clean_pred") == 1)
    a = pairs.groupBy(*(keys or [])).agg(F.count_if(found).alias("detected"),
                                         F.count_if(found & (F.col("attacked_pred") == 0)).alias("evaded"))
    return a.withColumn("evasion_rate", F.col("evaded") / F.greatest(F.lit(1), F.col("detected")))


# ------------------------------------------------------------------ information and redundancy
def mutual_information(df: DataFrame, features: dict[str, list[str]], label: str = "y", bins: int = 20) -> DataFrame:
    """Sum over a view's features of H(Y) - H(Y | equal-width bin), floored at zero."""
    cols = [c for v in features.values() for c in v]
    view_of = F.create_map(*[F.lit(x) for v, cs in features.items() for c in cs for x in (c, v)])
    ranges = df.agg(F.array(*[F.struct((F.min(c) - 1e-8).alias("lo"), (F.max(c) + 1e-8).alias("hi")) for c in cols]).alias("r"))
    one = F.broadcast(land(ranges.select(F.posexplode("r").alias("i", "r")), "ranges"))  # one row per feature
    long = df.select(label, F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("i", "v"))
    b = F.floor((F.col("v") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * bins)
    cells = long.join(one, "i").groupBy("i", b.alias("b"), label).agg(F.count(F.lit(1)).alias("n"))
    cells = land(cells, "cells")  # at most features * bins * classes rows

    def bits(part, total):
        p = part / total
        return -p * F.log2(p + 1e-12)

    size = cells.groupBy("i", "b").agg(F.sum("n").alias("nb"))
    rows = cells.groupBy("i").agg(F.sum("n").alias("t"))
    hy = cells.groupBy("i", label).agg(F.sum("n").alias("ny")).join(rows, "i").groupBy("i").agg(F.sum(bits(F.col("ny"), F.col("t"))).alias("hy"))
    hyb = cells.join(size, ["i", "b"]).join(rows, "i").groupBy("i").agg(
        F.sum(F.col("nb") / F.col("t") * bits(F.col("n"), F.col("nb"))).alias("hyb"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), (F.col("i") + 1).cast("int"))
    return hy.join(hyb, "i").select(view_of[name].alias("view"), F.greatest(F.lit(0.0), F.col("hy") - F.col("hyb")).alias("mi")).groupBy(
        "view").agg(F.sum("mi").alias("mutual_information"))


def view_redundancy(df: DataFrame, features: dict[str, list[str]]) -> DataFrame:
    """Mean absolute correlation between the columns of every two views, from one pass of cross products; constant columns are left out."""
    from tracegraph.operators import linear

    columns = [c for cs in features.values() for c in cs]
    r, at = np.abs(linear.correlations(df, columns)), {v: [columns.index(c) for c in cs] for v, cs in features.items()}
    rows = []
    for a, b in combinations(features, 2):
        cells = r[np.ix_(at[a], at[b])]
        cells = cells[~np.isnan(cells)]
        rows.append((a, b, float(cells.mean()) if len(cells) else 0.0))
    return df.sparkSession.createDataFrame(rows, "view_a string, view_b string, redundancy double")


def naive_bayes(df: DataFrame, features: dict[str, list[str]], folds: int = 5, key: str = "trace_id", floor: float = 1e-6) -> DataFrame:
    """Rows (key, y, view, llr): log odds of the positive class by each view's columns, from Gaussians of the rows outside the row's fold, without the prior.

    Columns are taken one by one: the moments of a (column, fold, class) are sums over folds, and the odds of a row add up over columns.
    ``floor`` is added to variances. Missing values count as 0.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(c).alias("f"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for v, cs in features.items() for c in cs])
    columns = [c for cs in features.values() for c in cs]
    long = stratified_folds(df.select(key, "y", *columns), folds, key=key).select(key, "y", "fold", F.explode(pairs).alias("p")).select(key, "y", "fold", "p.*")
    own = land(long.groupBy("f", "fold", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")), "moments")
    every = own.groupBy("f", "y").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    slots = own.select("f", "fold").distinct().join(every, "f").join(own, ["f", "fold", "y"], "left").na.fill(0)
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    known = slots.filter(n > 0).select("f", "fold", "y", (s / n).alias("m"), (F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)) + floor).alias("v"))
    both = known.groupBy("f", "fold").agg(*[F.max(F.when(F.col("y") == y, F.col(c))).alias(f"{c}{y}") for y in (0, 1) for c in "mv"])
    part = lambda y: -(F.log(f"v{y}") + (F.col("x") - F.col(f"m{y}")) * (F.col("x") - F.col(f"m{y}")) / F.col(f"v{y}")) / 2
    odds = F.coalesce(part(1) - part(0), F.lit(0.0))
    # one row per column and fold
    return long.join(F.broadcast(both), ["f", "fold"]).groupBy(key, "y", "view").agg(F.sum(odds).alias("llr"))


def view_order(df: DataFrame, features: dict[str, list[str]], folds: int = 5, key: str = "trace_id") -> tuple[DataFrame, DataFrame]:
    """(order, grown): F1 of every view alone with its rank, and F1 after adding the views in that order; out-of-fold, by ``naive_bayes``."""
    from pyspark.sql import Window

    odds = land(naive_bayes(df, features, folds, key), "view-odds")
    alone = binary_metrics(odds.withColumn("pred", (F.col("llr") > 0).cast("int")), ["view"])
    order = alone.select("view", "f1", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 9)), "view")).alias("view_rank"))  # one row per view
    order = land(order, "view-order")
    upto = order.select("view", F.explode(F.sequence("view_rank", F.lit(len(features)))).alias("view_rank"))
    grown = odds.join(F.broadcast(upto), "view").groupBy(key, "y", "view_rank").agg(F.sum("llr").alias("llr"))
    grown = binary_metrics(grown.withColumn("pred", (F.col("llr") > 0).cast("int")), ["view_rank"])
    return order, grown.join(order.select("view", "view_rank"), "view_rank").select("view", "view_rank", "f1")


def avg_redundancy_per_view(red: DataFrame) -> DataFrame:
    return red.select(F.explode(F.array("view_a", "view_b")).alias("view"), "redundancy").groupBy("view").agg(
        F.avg("redundancy").alias("avg_redundancy"))


# ------------------------------------------------------------------ significance
def welch_t(folds: DataFrame, base: str, method: str = "method", metric: str = "f1") -> DataFrame:
    s = folds.groupBy(method).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(F.lit(1)).alias("n"))
    ref = s.filter(F.col(method) == base).select(F.struct("mean", "std").alias("r"))
    r = land(ref, "reference").scalar()
    j = s.filter(F.col(method) != base).withColumn("r", r)
    floor = F.greatest(F.col("r.std"), F.lit(1e-6))
    se = F.sqrt(floor * floor / F.col("n") + F.col("std") * F.col("std") / F.col("n"))
    return j.select(method, (F.col("r.mean") - F.col("mean")).alias("delta"), div(F.col("r.mean") - F.col("mean"), se).alias("t"))


def wilcoxon_signed_rank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Smaller signed-rank sum of a - b per key, zero differences dropped, ties sharing their mean rank."""
    d = pairs.select(*keys, (F.col("a") - F.col("b")).alias("d")).filter("d <> 0").withColumn("m", F.round(F.abs("d"), 12))
    g = d.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    g = ordered.running(g, keys, ["m"], F.floor(F.least(F.col("m"), F.lit(1.0)) * 256), {"before": "n"}, inclusive=False)
    rank = F.col("before") + (F.col("n") + 1) / 2
    return g.groupBy(*keys).agg(F.sum(rank * F.col("up")).alias("w_plus"),
                                F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus")).withColumn(
        "statistic", F.least("w_plus", "w_minus"))


def tertile_strata(df: DataFrame, score: str = "cleanliness") -> DataFrame:
    """Dirty up to the 33.3rd percentile, medium up to the 66.7th, clean above."""
    cut = land(ordered.exact_percentiles(df, score, {"t33": 0.333, "t67": 0.667}).select(F.struct("t33", "t67").alias("t")), "cuts")
    return df.withColumn("_t", cut.scalar()).withColumn(
        "stratum", F.when(F.col(score) <= F.col("_t.t33"), "dirty").when(F.col(score) <= F.col("_t.t67"), "medium").otherwise("clean")).drop("_t")


def invariance_ratio(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """F1 on clean URLs over F1 on all, and over F1 on medium ones."""
    def f1(s):
        return F.max(F.when(F.col("stratum") == s, F.col("f1")))

    a = metrics.groupBy(*keys).agg(f1("clean").alias("clean"), f1("all").alias("all_f1"), f1("medium").alias("medium"))
    return a.select(*keys, (F.col("clean") / F.greatest(F.col("all_f1"), F.lit(1e-6))).alias("invariance"),
                    div(F.col("clean"), F.col("medium")).alias("clean_to_medium"))


def best_baseline_gain(metrics: DataFrame, ours: str) -> DataFrame:
    best = metrics.agg(F.max(F.when(F.col("method") == ours, F.col("f1"))).alias("f1"),
                       F.max_by(F.when(F.col("method") != ours, F.col("method")),
                                F.when(F.col("method") != ours, F.struct("f1", "method"))).alias("best_baseline"),
                       F.max(F.when(F.col("method") != ours, F.col("f1"))).alias("baseline_f1"))
    return best.withColumn("gain_pct", div((F.col("f1") - F.col("baseline_f1")) * 100, F.col("baseline_f1")))


def benign_prototype(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """(feature, mean, std) of benign rows; population deviation, 0 replaced by 1."""
    stats = df.filter(F.col(label) == 0).agg(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in features]).alias("s"))
    return stats.select(F.explode("s").alias("s")).select("s.feature", "s.mean", F.when(F.col("s.std") == 0, 1.0).otherwise(F.col("s.std")).alias("std"))


def standard_scale(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / population deviation, both taken from the training rows."""
    m = land(train.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features]).alias("z")), "scale")
    z = df.withColumn("_z", m.scalar())
    keep = [c for c in df.columns if c not in features]
    return z.select(*keep, *[((F.col(c) - F.col(f"_z.{c}.m")) / F.when(F.col(f"_z.{c}.s") == 0, 1.0).otherwise(F.col(f"_z.{c}.s"))).alias(c)
                             for c in features])


def running_view_gain(steps: DataFrame, start: float = 0.5) -> DataFrame:
    """F1 increments over views in order (view_rank, f1); a handful of rows."""
    from pyspark.sql import Window
    w = Window.orderBy("view_rank")
    return steps.withColumn("gain", F.col("f1") - F.lag("f1", 1, start).over(w))


def query_history(runs: DataFrame) -> DataFrame:
    return runs.groupBy("query").agg(F.count(F.lit(1)).alias("runs"), F.sum("found").alias("total_found"),
                                     F.avg("toxicity").alias("avg_toxicity"), F.min("run").alias("first_run"), F.max("run").alias("last_run"))


def running_mean_toxicity(runs: DataFrame) -> DataFrame:
    """Mean toxicity of a query over its runs so far, by running sums in slices of runs."""
    r = ordered.running(runs.withColumn("one", F.lit(1)), ["query"], ["run"], F.floor(F.col("run") / 1000), {"s": "toxicity", "k": "one"})
    return r.select("query", "run", (F.col("s") / F.col("k")).alias("running_mean"))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
