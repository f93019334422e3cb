"""Forests of the task's own size."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from millrace.operators import forest, train
from millrace.plans import QUERIES
from millrace.session import remove, workspace


def test_the_registered_forest_is_that_of_the_task(spark, monkeypatch):
    seen = {}

    def trained(df, task, hp, key):
        seen.update(train.TABULAR_DEFAULTS | hp)
        return train.Trained(None, {"rmse": 0.0}, {})

    monkeypatch.setattr(train, "train_tabular", trained)
    QUERIES["e_rf_reg"](spark, SMALL)
    assert seen == train.TABULAR_DEFAULTS | {"label_column": "p_retailprice"}


def data(n: int, seed: int = 5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 2, n), rng.integers(0, 4, n), np.zeros(n)])
    return x, rng.normal(size=n) + x[:, 0] * x[:, 1]


def plain(x, y, w, depth) -> list[float]:
    """Values of the leaves by splitting sets of rows one after the other."""
    best = None
    if depth and len(set(y)) > 1:
        for j in range(x.shape[1]):
            for cut in sorted(set(x[:, j]))[:-1]:
                low = x[:, j] <= cut
                gain = sum((w[s] @ y[s]) ** 2 / w[s].sum() for s in (low, ~low))
                if best is None or gain > best[0] + 1e-9:
                    best = gain, low
    if best is None:
        return [float(np.average(y, weights=w))]
    return [v for s in (best[1], ~best[1]) for v in plain(x[s], y[s], w[s], depth - 1)]


@pytest.mark.parametrize("depth", [1, 4, None])
def test_trees_are_those_of_plain_sums(depth):
    x, y = data(80)
    y[:12], w = 1.0, np.random.default_rng(1).integers(1, 4, 80)
    bins = forest.Bins.of([list(range(8)), [0], [0, 1, 2], []])
    counts, entries = bins.listed(x.astype(np.uint8))
    assert (bins.matrix(counts, entries) == x).all()
    tree = forest.grown(y, w, counts, entries, bins, depth)
    leaves = tree.value[tree.feature < 0]
    assert sorted(leaves) == pytest.approx(sorted(plain(x, y, w, 99 if depth is None else depth)))


def test_no_depth_is_set_for_trees_of_many_levels():
    bins = forest.Bins.of([list(range(60))])
    counts, entries = bins.listed(np.arange(61, dtype=np.uint8)[:, None])
    tree = forest.grown(3.0 ** np.arange(61), np.ones(61), counts, entries, bins, None)
    assert (tree.feature < 0).sum() == 61


def frame(spark, x, y):
    rows = [(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "label", "features"])


def test_large_nodes_and_batches_give_the_same_forest(spark, monkeypatch):
    x, y = data(300)
    rows = frame(spark, x, y).repartition(3, "id").cache()

    def fitted():
        model = forest.ForestRegressor(numTrees=7, maxDepth=6).fit(rows)
        return model, {r.id: r.prediction for r in model.transform(rows).collect()}

    _, one = fitted()
    monkeypatch.setattr(forest, "LOCAL", 60)
    monkeypatch.setattr(forest, "MOVED", 1 << 15)
    monkeypatch.setattr(forest, "ROWS", 70)
    model, cut = fitted()
    assert '"trees": [[[-1], ' not in model.getOrDefault(model.upper)
    assert len(one) == 300 and cut == pytest.approx(one)
    rows.unpersist()


def test_a_saved_forest_has_its_trees_with_it(spark):
    x, y = data(60)
    rows = frame(spark, x, y)
    model = forest.ForestRegressor(numTrees=3).fit(rows)
    before = {r.id: r.prediction for r in model.transform(rows).collect()}
    path = workspace(spark, "forest-model")
    PipelineModel([model]).write().save(path)
    remove(spark, model.getOrDefault(model.folder))
    after = {r.id: r.prediction for r in PipelineModel.load(path).transform(rows).collect()}
    assert after == before
