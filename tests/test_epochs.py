"""Training in epochs of mini-batches: gradients, best state and restarts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import epochs, train
from millrace.session import workspace


def rows_of(n: int, classes: int, features: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = int(rng.integers(classes))
        index = sorted({label, *rng.integers(classes, features, 3).tolist()})
        out.append((label, [int(j) for j in index], [1.0] * len(index), i % 5 == 0))
    return out


SCHEMA = "label int, indices array<int>, values array<double>, is_test boolean"


def dense(rows, features: int):
    x = np.zeros((len(rows), features + 1))
    for n, (_, index, value, _) in enumerate(rows):
        x[n, index] = value
    x[:, -1] = 1
    return x, np.array([r[0] for r in rows])


def test_a_step_is_the_gradient_of_the_mean_loss(spark):
    rows = rows_of(300, 3, 20)
    weights = np.random.default_rng(1).normal(size=(3, 21))
    gradient, n, loss = epochs._step(spark.createDataFrame(rows, SCHEMA).drop("is_test").repartition(7), weights)
    x, y = dense(rows, 20)
    p = np.exp(x @ weights.T)
    p /= p.sum(axis=1, keepdims=True)
    assert n == 300 and loss == pytest.approx(-np.log(p[np.arange(300), y]).mean())
    p[np.arange(300), y] -= 1
    assert np.allclose(gradient, p.T @ x / 300)
    empty = spark.createDataFrame([], SCHEMA).drop("is_test")
    assert epochs._step(empty, weights)[1:] == (0, 0.0)
    assert epochs.evaluate(empty, weights) == {"accuracy": 0.0, "eval_loss": 0.0}


def test_epochs_learn_and_go_on_after_a_stop(spark):
    rows = spark.createDataFrame(rows_of(600, 3, 30, 2), SCHEMA)
    batches, whole, parts = (workspace(spark, name) for name in ("batches", "whole", "parts"))
    epochs.mini_batches(rows, batches, "is_test", steps=4)
    found = epochs.fit(spark, batches, whole, 3, 30, 3, steps=4)
    assert [(p["epoch"], p["step"]) for p in found.points] == [(1, 4), (2, 8), (3, 12)]
    assert found.best["accuracy"] > 0.95 and found.points[0]["loss"] > found.points[2]["loss"]
    first = max(found.points, key=lambda p: (p["accuracy"], -p["epoch"]))
    assert found.best == first
    # Two epochs, then a third by another call: the same weights as in one go.
    epochs.fit(spark, batches, parts, 3, 30, 2, steps=4)
    said = []
    again = epochs.fit(spark, batches, parts, 3, 30, 3, said.append, steps=4)
    assert len(said) == 1 and np.allclose(again.weights, found.weights)
    assert [p["epoch"] for p in again.points] == [1, 2, 3]
    half = epochs.fit(spark, batches, workspace(spark, "half"), 3, 30, 0.5, steps=4)
    assert [(p["epoch"], p["step"]) for p in half.points] == [(1, 2)]


def test_weights_stay_within_their_bound():
    assert epochs.features_for(2, 1 << 16) == 1 << 16
    for classes in (300, 10_000):
        size = epochs.features_for(classes, 1 << 16)
        assert size & (size - 1) == 0 and (size + 1) * classes <= epochs.MAX_WEIGHTS < (2 * size + 1) * classes


def test_text_model_is_that_of_the_best_epoch(spark, tmp_path):
    texts = {"a": "red apple on a tree", "b": "blue sky over the sea", "c": "green frog in the pond"}
    rows = [(n, f"{texts['abc'[n % 3]]} {n % 11}", "abc"[n % 3]) for n in range(240)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    said = []
    trained = train.train_text(df, {"epochs": 2}, "id", said.append, buckets=1 << 10)
    assert trained.metrics["accuracy"] == 1.0 and trained.metrics["num_classes"] == 3
    assert trained.metrics["train_rows"] + trained.metrics["eval_rows"] == 240
    assert [p["epoch"] for p in trained.history] == [1, 2] and any("epoch 2" in s for s in said)
    train.save_model(trained, spark, str(tmp_path / "m"))
    scored = train.score(str(tmp_path / "m"), df.drop("label")).join(df.select("id", "label"), "id")
    assert scored.where(F.col("predicted") == F.col("label")).count() == 240
