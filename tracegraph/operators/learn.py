"""Classifiers, cross-validation and ensembles on MLlib.

Feature tables are landed once per evaluation with their fold; folds are fitted
side by side from a small thread pool, each fit being an ordinary Spark job.
MLlib's scaler divides by the sample deviation; against the population one this
scales every column by the same factor sqrt(n / (n - 1)).
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.operators import fits, linear, stats
from tracegraph.operators.embed import _project
from tracegraph.session import land, scratch_path

Maker = Callable[[int, int], object]  # (rows, columns) -> estimator


def gbm(trees: int = 200, depth: int = 5, step: float = 0.1, subsample: float = 0.8) -> Maker:
    return lambda n, d: GBTClassifier(labelCol="y", featuresCol="x", maxIter=trees, maxDepth=depth, stepSize=step,
                                      subsamplingRate=subsample, weightCol="weight", seed=42)


def rf(trees: int = 500, depth: int = 30) -> Maker:
    return lambda n, d: RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth,
                                               weightCol="weight", seed=42)


def lr(c: float = 1.0, rounds: int = 1000) -> Maker:
    return lambda n, d: LogisticRegression(labelCol="y", featuresCol="x", regParam=1.0 / (c * max(1, n)), maxIter=rounds,
                                           weightCol="weight")


def mlp(*hidden: int, rounds: int = 500) -> Maker:
    return lambda n, d: MultilayerPerceptronClassifier(labelCol="y", featuresCol="x", layers=[d, *(hidden or (128, 64)), 2],
                                                       maxIter=rounds, seed=42)


def svm(c: float = 10.0, rounds: int = 100) -> Maker:
    """Linear machine; ``fourier_features`` in front of it gives the radial kernel."""
    return lambda n, d: LinearSVC(labelCol="y", featuresCol="x", regParam=1.0 / (c * max(1, n)), maxIter=rounds, weightCol="weight")


def fourier_features(df: DataFrame, columns: list[str], width: int = 128) -> tuple[DataFrame, list[str]]:
    """Random cosine columns approximating the radial kernel with gamma = 1 / columns on scaled data."""
    rng = np.random.RandomState(42)
    w = rng.randn(len(columns), width) * np.sqrt(2.0 / len(columns))
    b = rng.uniform(0, 2 * np.pi, width)
    z = stats.standard_scale(df, df, columns)
    arr = _project(lambda x: np.sqrt(2.0 / width) * np.cos(x @ w + b))(F.array(*columns))
    names = [f"rff_{i}" for i in range(width)]
    keep = [c for c in df.columns if c not in columns]
    out = land(z.select(*keep, arr.alias("_r")), "fourier")
    return out.select(*keep, *[F.col("_r")[i].alias(n) for i, n in enumerate(names)]), names


def prepare(df: DataFrame, columns: list[str], folds: int, key: str = "trace_id") -> DataFrame:
    """(key, y, fold, weight, raw vector), landed."""
    f = stats.stratified_folds(df.select(key, "y", *columns), folds, key=key)
    f = stats.balanced_weights(f)
    v = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep").transform(f)
    return land(v.select(key, F.col("y").cast("double").alias("y"), "fold", "weight", "raw"), "assembled")


def prepare_sets(df: DataFrame, sets: dict[str, list[str]], folds: int, key: str = "trace_id") -> DataFrame:
    """Like prepare, with one vector ``raw_{name}`` per column set, landed once for all of them."""
    every = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    v = stats.balanced_weights(stats.stratified_folds(df.select(key, "y", *every), folds, key=key))
    for name, cs in sets.items():
        v = VectorAssembler(inputCols=cs, outputCol=f"raw_{name}", handleInvalid="keep").transform(v)
    return land(v.select(key, F.col("y").cast("double").alias("y"), "fold", "weight", *[f"raw_{n}" for n in sets]), "assembled")


def one_set(data: DataFrame, name: str, key: str = "trace_id") -> DataFrame:
    return data.select(key, "y", "fold", "weight", F.col(f"raw_{name}").alias("raw"))


def landed_model(model: PipelineModel) -> PipelineModel:
    """The model as stored in the shared folder and read back.

    A fitted linear model or forest carries its training summary and with it the session into every task that predicts; a session that
    has observed a write cannot be sent. The stored model has no summary.
    """
    path = scratch_path(SparkSession.active(), "model")
    model.write().save(path)
    return PipelineModel.load(path)


def fit(train: DataFrame, maker: Maker, width: int) -> PipelineModel:
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)
    return landed_model(Pipeline(stages=[scaler, maker(train.count(), width)]).fit(train))


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    p = model.transform(df)
    if "probability" in p.columns:
        score = vector_to_array("probability")[1]
    else:
        score = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    return p.select(*keep, score.alias("score"), F.col("prediction").cast("int").alias("pred"))


def out_of_fold(data: DataFrame, maker: Maker, width: int, folds: int, workers: int = 4, key: str = "trace_id") -> DataFrame:
    """Predictions of every row from the model that did not see its fold."""
    def one(i: int) -> DataFrame:
        model = fit(data.filter(F.col("fold") != i), maker, width)
        return predict(model, data.filter(F.col("fold") == i), [key, "y", "fold"])

    with ThreadPool(min(workers, folds)) as pool:
        parts = pool.map(inheritable_thread_target(data.sparkSession)(one), range(folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


METRICS = ["accuracy", "precision", "recall", "f1", "auc"]


def fold_metrics(oof: DataFrame, keys: list[str]) -> DataFrame:
    m = stats.binary_metrics(oof, [*keys, "fold"]).join(stats.roc_auc(oof, [*keys, "fold"]), [*keys, "fold"])
    return stats.fold_metric_summary(m, keys, METRICS)


def cross_validate(df: DataFrame, columns: list[str], maker: Maker, folds: int = 10, name: str = "model") -> DataFrame:
    data = prepare(df, columns, folds)
    oof = land(out_of_fold(data, maker, len(columns), folds), "out-of-fold")
    return fold_metrics(oof.withColumn("method", F.lit(name)), ["method"])


def compare(df: DataFrame, cases: dict[str, tuple[list[str], Maker]], folds: int = 10) -> DataFrame:
    """cross_validate of several column sets and classifiers in one table."""
    slots = {f"s{i}": c for i, (c, _) in enumerate(cases.values())}
    data = prepare_sets(df, slots, folds)

    def one(item) -> DataFrame:
        slot, (name, (columns, maker)) = item
        return out_of_fold(one_set(data, slot), maker, len(columns), folds, 2).withColumn("method", F.lit(name))

    with ThreadPool(4) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), list(zip(slots, cases.items())))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return fold_metrics(land(rows, "out-of-fold"), ["method"])


def linear_compare(df: DataFrame, sets: dict[str, list[str]], folds: int = 10, c: float = 1.0) -> DataFrame:
    """``compare`` for penalised logistic regression on several column sets, all folds and sets fitted together to the optimum."""
    return fold_metrics(land(linear.out_of_fold(df, sets, folds, c), "out-of-fold"), ["method"])


def maker_of(learner: fits.Learner) -> Maker:
    """The same learner by MLlib, for tables that no task may hold; every fit is weighted there, and depth ends at 30."""
    p = learner.params
    return {"forest": lambda: rf(p["trees"], min(p["depth"] or 30, 30)), "boosted": lambda: gbm(p["trees"], p["depth"], p["step"], p["subsample"]),
            "network": lambda: mlp(*p["hidden"], rounds=p["rounds"]), "logistic": lambda: lr(p["c"])}[learner.kind]()


def out_of_fold_whole(df: DataFrame, cases: dict[str, tuple[list[str], fits.Learner]], folds: int = 10) -> DataFrame:
    """Rows (method, trace_id, y, fold, score, pred): every case's scores from the fits that did not see the fold, all fits side by side in tasks."""
    every = list(dict.fromkeys(c for cs, _ in cases.values() for c in cs))
    path, rows, k = fits.lay(df, every, folds)
    keep = ["method", "trace_id", "y", "fold", "score"]
    near = {m: c for m, c in cases.items() if fits.fits_in_task(rows, len(c[0]), c[1].kind)}
    parts = []
    if near:
        parts.append(fits.run(df.sparkSession, [fits.Fit(m, path, tuple(cs), learner, o) for m, (cs, learner) in near.items() for o in range(k)]).select(*keep))
    for m in cases.keys() - near.keys():
        cs, learner = cases[m]
        oof = out_of_fold(prepare(df, cs, k), maker_of(learner), len(cs), k)
        parts.append(land(oof.withColumn("method", F.lit(m)).select(*[F.col(c).cast("int") if c in ("y", "fold") else F.col(c) for c in keep]), "out-of-fold"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def train_and_score(df: DataFrame, cases: dict[str, tuple[list[str], fits.Learner]]) -> DataFrame:
    """Rows (method, trace_id, score, pred) of fold 0, from fits on the other rows."""
    path = scratch_path(df.sparkSession, "study")
    df.withColumn("pos", F.lit(0).cast("long")).write.parquet(path)
    df = df.sparkSession.read.parquet(path)
    rows, parts, near = df.count(), [], {}
    for m, (cs, learner) in cases.items():
        if fits.fits_in_task(rows, len(cs), learner.kind):
            near[m] = fits.Fit(m, path, tuple(cs), learner, 0)
        else:
            model = fit(prepare(df.filter("fold <> 0"), cs, 2), maker_of(learner), len(cs))
            x = VectorAssembler(inputCols=cs, outputCol="raw", handleInvalid="keep").transform(df.filter("fold = 0").select("trace_id", *cs))
            parts.append(predict(model, x, ["trace_id"]).select(F.lit(m).alias("method"), "trace_id", "score"))
    if near:
        parts.append(fits.run(df.sparkSession, list(near.values())).select("method", "trace_id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))


def evaluate(df: DataFrame, cases: dict[str, tuple[list[str], fits.Learner]], folds: int = 10) -> DataFrame:
    """Metrics over folds of whole learners, one row per case."""
    return fold_metrics(out_of_fold_whole(df, cases, folds), ["method"])


# ------------------------------------------------------------------ ensembles
def view_scores(df: DataFrame, views: dict[str, list[str]], makers: dict[str, Maker], folds: int) -> DataFrame:
    """One out-of-fold probability column per view (the folds are the same for every view)."""
    data = prepare_sets(df, views, folds)

    def one(v: str) -> DataFrame:
        p = out_of_fold(one_set(data, v), makers[v], len(views[v]), folds, 2)
        return land(p, "view-score").select("trace_id", "y", "fold", F.col("score").alias(f"p_{v}"))

    with ThreadPool(4) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), list(views))
    out = parts[0]
    for v, p in zip(list(views)[1:], parts[1:]):
        out = out.join(p.select("trace_id", f"p_{v}"), "trace_id")
    return out


VIEW_WEIGHTS = {"url": 2.5, "network": 1.5, "redirect": 1.0, "interaction": 1.0, "itg": 1.5, "cross": 1.0}


def vote(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or VIEW_WEIGHTS
    total = sum(weights.values())
    s = None
    for v, w in weights.items():
        term = F.col(f"p_{v}") * (w / total)
        s = term if s is None else s + term
    return scores.withColumn("score", s).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def soft_vote_mve(df: DataFrame, views: dict[str, list[str]], makers: dict[str, Maker], folds: int = 10,
                  weights: dict[str, float] | None = None) -> DataFrame:
    p = vote(view_scores(df, views, makers, folds), weights)
    return fold_metrics(p.withColumn("method", F.lit("soft_vote")), ["method"])


def stacked_smve(df: DataFrame, views: dict[str, list[str]], makers: dict[str, Maker], folds: int = 10, inner: int = 3,
                 final_trees: int = 100) -> DataFrame:
    """Inner out-of-fold view scores plus the raw URL view, scored by the mean of a linear and a boosted model."""
    return _stacked(df, views, makers, [lr(), gbm(final_trees, 3)], views["url"], folds, inner, "stacked")


def _stacked(df: DataFrame, views: dict[str, list[str]], makers: dict[str, Maker], finals: list[Maker], raw: list[str], folds: int, inner: int, name: str) -> DataFrame:
    base = land(stats.stratified_folds(df, folds), "outer")
    rows = None
    for i in range(folds):
        train, test = base.filter(F.col("fold") != i).drop("fold"), base.filter(F.col("fold") == i).drop("fold")
        tr = view_scores(train, views, makers, inner).drop("fold", "y").join(train, "trace_id")
        whole = prepare_sets(train, views, 2)

        def score(v: str, whole=whole, test=test) -> DataFrame:
            model = fit(one_set(whole, v), makers[v], len(views[v]))
            x = VectorAssembler(inputCols=views[v], outputCol="raw", handleInvalid="keep").transform(test.select("trace_id", *views[v]))
            return predict(model, x, ["trace_id"]).select("trace_id", F.col("score").alias(f"p_{v}"))

        with ThreadPool(4) as pool:
            parts = pool.map(inheritable_thread_target(df.sparkSession)(score), list(views))
        te = test
        for p in parts:
            te = te.join(p, "trace_id")
        cols = [f"p_{v}" for v in views] + raw
        data = prepare(tr, cols, 2)
        final = land(VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="keep").transform(te).select("trace_id", "y", "raw"), "stack-test")
        got = None
        for n, maker in enumerate(finals):
            one = predict(fit(data, maker, len(cols)), final, ["trace_id", "y"]).select("trace_id", "y", F.col("score").alias(f"s{n}"))
            got = one if got is None else got.join(one.drop("y"), "trace_id")
        got = got.withColumn("score", sum(F.col(f"s{n}") for n in range(len(finals))) / len(finals)).select(
            "trace_id", "y", F.lit(i).alias("fold"), "score", (F.col("score") > 0.5).cast("int").alias("pred"))
        rows = got if rows is None else rows.unionByName(got)
    return fold_metrics(land(rows, "stacked").withColumn("method", F.lit(name)), ["method"])


def stacked_whole(df: DataFrame, bases: dict[str, tuple[list[str], fits.Learner]], finals: list[fits.Learner], raw: list[str], name: str,
                  folds: int = 10, inner: int = 3) -> DataFrame:
    """Base scores of inner folds with the columns ``raw``, scored by the mean of the final learners; every outer fold learns both layers anew, all fits side by side in tasks."""
    rows, k = df.count(), stats.fold_count(df, most=folds)
    kinds = [(len(cs), learner.kind) for cs, learner in bases.values()] + [(len(bases) + len(raw), f.kind) for f in finals]
    if not all(fits.fits_in_task(rows, n, kind) for n, kind in kinds):
        return _stacked(df, {m: cs for m, (cs, _) in bases.items()}, {m: maker_of(f) for m, (_, f) in bases.items()}, [maker_of(f) for f in finals], raw, k, inner, name)
    got = fits.stacked(df, bases, finals, raw, k, inner).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return fold_metrics(got.withColumn("method", F.lit(name)), ["method"])


def stack_concat(df: DataFrame, columns: list[str], learners: dict[str, fits.Learner], folds: int = 10, inner: int = 3) -> DataFrame:
    """Several classifiers on the same columns, stacked by a linear model over their out-of-fold scores."""
    return stacked_whole(df, {m: (columns, learner) for m, learner in learners.items()}, [fits.logistic(balanced=False)], [], "stack", folds, inner)


# ------------------------------------------------------------------ studies
def information_gain(df: DataFrame, views: dict[str, list[str]], folds: int = 10) -> DataFrame:
    """F1 of each view alone, then the gain of adding views from strongest to weakest (start 0.5), by penalised logistic regression."""
    solo = linear_compare(df, views, folds).select("method", "f1").collect()  # one row per view
    order = [r["method"] for r in sorted(solo, key=lambda r: (-r["f1"], r["method"]))]
    cases, cols = {}, []
    for n, v in enumerate(order):
        cols = cols + views[v]
        cases[f"{n + 1}:{v}"] = cols
    grown = linear_compare(df, cases, folds).select(F.split_part("method", F.lit(":"), F.lit(1)).cast("int").alias("view_rank"),
                                                    F.split_part("method", F.lit(":"), F.lit(2)).alias("view"), "f1")
    alone = df.sparkSession.createDataFrame([(r["method"], r["f1"]) for r in solo], "view string, solo_f1 double")
    return stats.running_view_gain(grown).join(alone, "view")


def feature_importance(df: DataFrame, columns: list[str], maker: Maker) -> DataFrame:
    model = fit(prepare(df, columns, 2), maker, len(columns)).stages[-1]
    imp = model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(columns, imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def train_score(train: DataFrame, new: DataFrame, columns: list[str], maker: Maker, path: str) -> DataFrame:
    """Fit on all labelled rows, store the model, load it and score new rows."""
    fit(prepare(train, columns, 2), maker, len(columns)).write().overwrite().save(path)
    model = PipelineModel.load(path)
    x = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep").transform(new)
    p = predict(model, x, ["trace_id"])
    return p.select("trace_id", F.col("pred").alias("prediction"), F.when(F.col("pred") == 1, "phishing").otherwise("benign").alias("label"),
                    F.col("score").alias("prob_phishing"), F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"))


def gradient_perturb(test: DataFrame, model: PipelineModel, columns: list[str], epsilons: list[float], delta: float = 1e-4) -> DataFrame:
    """Finite-difference sign step against P(positive) for positives; every row becomes d + 1 probes, scored in one pass.

    ``test`` holds scaled columns and ``model`` takes them as they are.
    """
    d = len(columns)
    x = test.select("trace_id", "y", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    probes = x.filter("y = 1").select("trace_id", "v", F.explode(F.sequence(F.lit(-1), F.lit(d - 1))).alias("j"))
    moved = F.transform("v", lambda e, i: F.when(i == F.col("j"), e + delta).otherwise(e))
    scored = predict(model, probes.select("trace_id", "j", array_to_vector(moved).alias("x")), ["trace_id", "j"])
    g = scored.groupBy("trace_id").agg(F.max(F.when(F.col("j") == -1, F.col("score"))).alias("base"),
                                       F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("by"))  # d + 1 entries per row
    sign = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.signum(F.element_at("by", j) - F.col("base")))
    grad = land(g.select("trace_id", sign.alias("sign")), "gradient")
    out = None
    for eps in epsilons:
        j = x.join(grad, "trace_id", "left")
        step = F.when(F.col("sign").isNotNull(), F.zip_with("v", "sign", lambda a, s: a - eps * s)).otherwise(F.col("v"))
        p = predict(model, j.select("trace_id", "y", array_to_vector(step).alias("x")), ["trace_id", "y"]).withColumn("epsilon", F.lit(eps))
        out = p if out is None else out.unionByName(p)
    return out
