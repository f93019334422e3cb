"""Boosting of several classes against the same sums written out, and its model on disk."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors

from millrace.operators import boosting, train


def data(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] + x[:, 3] > 0.8)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])


def plain(bins: np.ndarray, y: np.ndarray, classes: int, rounds: int, depth: int, width: int) -> np.ndarray:
    """Raw scores by splitting sets of rows one after the other."""
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            g = (y == k) - p[:, k]
            h = np.abs(g) * (1 - np.abs(g))

            def split(rows, level):
                best = (1e-12, None)
                for j in range(bins.shape[1]):
                    for cut in range(width - 1):
                        left = rows[bins[rows, j] <= cut]
                        right = rows[bins[rows, j] > cut]
                        if len(left) and len(right):
                            gain = len(left) * len(right) / len(rows) * (g[left].mean() - g[right].mean()) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (left, right))
                if level == depth or best[1] is None:
                    step[rows, k] = (classes - 1) / classes * g[rows].sum() / h[rows].sum()
                else:
                    for part in best[1]:
                        split(part, level + 1)

            split(np.arange(len(y)), 0)
        scores += boosting.RATE * step
    return scores


def test_trees_are_those_of_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_CARRY", 2)
    x, y = data(160)
    model = boosting.BoostedClassifier(maxIter=3, maxDepth=2).fit(frame(spark, x, y).repartition(5))
    edges, prior, rounds = model.rounds()
    bins = boosting.binned(x, edges)
    assert [len(trees) for trees in rounds] == [3, 3, 3]
    got = boosting.raw_scores(rounds, bins, np.tile(prior, (len(x), 1)))
    assert np.allclose(got, plain(bins, y, 3, 3, 2, boosting.BINS))


def test_model_learns_and_is_read_back(spark, tmp_path):
    x, y = data(900, 5)
    model = boosting.BoostedClassifier(maxIter=20, maxDepth=3).fit(frame(spark, x[:600], y[:600]))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = boosting.BoostedModel.load(str(tmp_path / "m"))
    rows = again.transform(frame(spark, x[600:], y[600:])).collect()
    assert np.mean([r.prediction == r.label for r in rows]) > 0.93


def test_one_joint_model_for_more_than_two_classes(spark, tmp_path):
    x, y = data(300, 7)
    rows = [(n, *map(float, a), "abc"[b]) for n, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, p double, q double, r double, s double, label string")
    settings = {"label_column": "label", "algorithm": "gradient_boosting", "n_estimators": 12}
    trained = train.train_tabular(df.drop("id"), "tabular-classification", settings)
    assert trained.metrics["accuracy"] > 0.8
    assert sum(isinstance(s, boosting.BoostedModel) for s in trained.model.stages) == 1
    train.save_model(trained, spark, str(tmp_path / "m"))
    scored = train.score(str(tmp_path / "m"), df.drop("label")).collect()
    assert np.mean([r.predicted == rows[r.id][-1] for r in scored]) > 0.8
