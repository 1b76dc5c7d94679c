"""Fitted models can be sent to tasks whatever the session has done before."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from tracegraph.operators import learn
from tracegraph.session import land


@pytest.mark.parametrize("name", ["lr", "rf", "svm", "mlp", "gbm"])
def test_prediction_after_an_observed_write(spark, name):
    seen = Observation()
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 10
    rng = random.Random(5)
    rows = [(i, y, rng.gauss(3 * y, 1), rng.gauss(0, 1)) for i in range(60) for y in [i % 2]]
    df = spark.createDataFrame(rows, "trace_id long, y int, a double, b double")
    maker = {"lr": learn.lr(1.0, 20), "rf": learn.rf(3, 3), "svm": learn.svm(10.0, 10), "mlp": learn.mlp(4, rounds=30), "gbm": learn.gbm(2, 2)}[name]
    data = learn.prepare(df, ["a", "b"], 2)
    got = land(learn.predict(learn.fit(data, maker, 2), data, ["trace_id", "y"]), "predicted")
    assert got.count() == 60 and got.filter("pred = y").count() >= 45
