"""Gradient boosting of several classes as one model: a tree per class and round on a shared loss.

Features are cut into bins once. A level of all trees of a round is one job: tasks add up
histograms of residuals by (class, node, feature, bin), a second stage adds those of all tasks
and picks the best split of each node, and the driver sees one row per node. Scores are carried
along with the rows every few rounds, so a job walks few trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed

BINS = 64
RATE = 0.1
#: Cells of a level's histograms at most; with more columns or classes the bins get fewer.
MAX_CELLS = 1 << 24
#: Rounds whose trees a job walks before scores are written with the rows.
_CARRY = 16
_PART = 50
_SPLIT = (
    "tree int, node int, feature int, cut int, gain double, rows double, total double, weight double, "
    "left_total double, left_weight double"
)


def bin_edges(rows: DataFrame, vector: str, size: int, bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins but the last: approximate quantiles of all rows."""
    shares = F.lit([n / bins for n in range(1, bins)])
    out: list[list[float]] = []
    for start in range(0, size, _PART):
        wanted = [
            F.percentile_approx(F.col(vector)[j], shares, F.lit(100 * bins)).alias(f"q{j}")
            for j in range(start, min(start + _PART, size))
        ]
        tops = [F.max(F.col(vector)[j]).alias(f"m{j}") for j in range(start, min(start + _PART, size))]
        row = rows.agg(*wanted, *tops).first()
        for j in range(start, min(start + _PART, size)):
            out.append(sorted({v for v in row[f"q{j}"] or [] if v < row[f"m{j}"]}))
    return out


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: values up to an edge lie in its bin."""
    out = np.zeros(x.shape, np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, x[:, j], "left")
    return out


class Tree:
    """A complete binary tree of bins: node ``n`` has the children ``2 n + 1`` and ``2 n + 2``."""

    def __init__(self, depth: int):
        inner, every = 2**depth - 1, 2 ** (depth + 1) - 1
        self.depth, self.feature, self.cut = depth, np.full(inner, -1, np.int32), np.zeros(inner, np.int32)
        self.value = np.zeros(every)

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of each row after ``depth`` levels; rows stay where a node is not split."""
        at = np.zeros(len(bins), np.int64)
        for level in range(depth):
            inner = np.minimum(at, len(self.feature) - 1)
            feature = np.where(at < len(self.feature), self.feature[inner], -1)
            # A row that stopped on an earlier level stays there.
            moves = (feature >= 0) & (at >= 2**level - 1)
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.cut[inner]
            at = np.where(moves, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


def raw_scores(rounds: list[list[Tree]], bins: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += RATE * tree.scores(bins)
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _histograms(shared, bins: int, level: int):
    """One row per class: rows, residuals and weights of a task by (node, feature, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, trees = shared.value
        first, width, total = 2**level - 1, 2**level, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _matrix(batch.column("bins"), np.uint8), batch.column("label").to_numpy()
            p = _softmax(raw_scores(before, x, _matrix(batch.column("scores"), np.float64)))
            residual = -p
            residual[np.arange(len(label)), label] += 1
            weight = np.abs(residual) * (1 - np.abs(residual))
            size = x.shape[1]
            if total is None:
                total = np.zeros((len(trees), 3, width * size * bins))
            for k, tree in enumerate(trees):
                node = tree.nodes(x, level) - first
                live = np.flatnonzero(node >= 0)
                cell = ((node[live, None] * size + np.arange(size)) * bins + x[live]).ravel()
                for n, values in enumerate((np.ones(len(live)), residual[live, k], weight[live, k])):
                    total[k, n] += np.bincount(cell, np.repeat(values, size), minlength=total.shape[2])
        if total is not None:
            data = pa.array([t.tobytes() for t in total], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), data], names=["tree", "data"])

    return run


def best_splits(total: np.ndarray) -> list[tuple]:
    """Best split of every node from its histograms (3 x nodes x features x bins).

    The gain is that of squared residuals as Friedman weighs it; of equal ones the first
    feature and bin count.
    """
    out = []
    for node in range(total.shape[1]):
        rows, sums, weights = total[:, node]
        n, s, w = rows[0].sum(), sums[0].sum(), weights[0].sum()
        left_n, left_s = rows.cumsum(axis=1)[:, :-1], sums.cumsum(axis=1)[:, :-1]
        right_n = n - left_n
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = left_s / left_n - (s - left_s) / right_n
            gain = np.where((left_n > 0.5) & (right_n > 0.5), left_n * right_n / n * apart**2, -1.0)
        best = int(gain.argmax()) if gain.size else 0
        j, cut = divmod(best, max(gain.shape[1], 1))
        if gain.size and gain[j, cut] > 1e-12:
            held = weights[j].cumsum()[cut]
            out.append((node, j, cut, float(gain[j, cut]), n, s, w, left_s[j, cut], held))
        else:
            out.append((node, -1, 0, 0.0, n, s, w, 0.0, 0.0))
    return out


def _reduced(nodes: int, size: int, bins: int):
    """Add the histograms of a class up and choose its splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("data").to_pylist()):
                found = np.frombuffer(data)
                totals[tree] = totals[tree] + found if tree in totals else found.copy()
        rows = [(t, *split) for t, total in totals.items() for split in best_splits(total.reshape(3, nodes, size, bins))]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.float64()] * 6
            names = [pair.split()[0] for pair in _SPLIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def grow(rows: DataFrame, classes: int, size: int, bins: int, rounds: int, depth: int) -> list[list[Tree]]:
    """Trees of every round from ``label``, ``bins`` and ``scores`` (doubles per class, the start of all)."""
    context, done, waiting = rows.sparkSession.sparkContext, [], []
    share = (classes - 1) / classes
    for _ in range(rounds):
        trees = [Tree(depth) for _ in range(classes)]
        for level in range(depth):
            shared = context.broadcast((waiting, trees))
            partial = rows.mapInArrow(_histograms(shared, bins, level), "tree int, data binary").repartition("tree")
            found = partial.mapInArrow(_reduced(2**level, size, bins), _SPLIT).collect()
            shared.unpersist()
            for r in found:
                tree, n = trees[r.tree], 2**level - 1 + r.node
                if r.rows and not level:
                    tree.value[0] = _leaf(share, r.total, r.weight)
                if r.feature >= 0:
                    tree.feature[n], tree.cut[n] = r.feature, r.cut
                    tree.value[2 * n + 1] = _leaf(share, r.left_total, r.left_weight)
                    tree.value[2 * n + 2] = _leaf(share, r.total - r.left_total, r.weight - r.left_weight)
        done.append(trees)
        waiting.append(trees)
        if len(waiting) == _CARRY:
            rows, waiting = _carried(rows, waiting), []
    return done


def _leaf(share: float, total: float, weight: float) -> float:
    return share * total / weight if abs(weight) > 1e-150 else 0.0


def _carried(rows: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("bins"), np.uint8)
                new = raw_scores(shared.value, x, _matrix(batch.column("scores"), np.float64))
                scores = pa.array([r.tobytes() for r in new], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("bins"), scores], names=["label", "bins", "scores"])

    return checkpointed(rows.mapInArrow(run, "label int, bins binary, scores binary"), "boosting")


class _Shared(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class index column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "predicted class index", TypeConverters.toString)


class BoostedClassifier(Estimator, _Shared):
    """Multinomial gradient boosting, trees of ``maxDepth``, ``maxIter`` rounds of one tree per class."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, maxDepth=3):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=100, maxDepth=3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        label = F.col(self.getOrDefault(self.labelCol)).cast("int").alias("label")
        vectors = dataset.select(label, vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"))
        vectors = checkpointed(vectors, "boosting-rows")
        counts = {r.label: r["count"] for r in vectors.groupBy("label").count().collect()}
        classes, size = max(counts) + 1, len(vectors.first().x)
        depth, bins = self.getOrDefault(self.maxDepth), BINS
        while bins > 8 and classes * 2 ** (depth - 1) * size * bins > MAX_CELLS:
            bins //= 2
        edges = bin_edges(vectors, "x", size, bins)
        share = np.array([counts.get(k, 0) for k in range(classes)]) / sum(counts.values())
        prior = np.log(np.maximum(share, np.finfo(np.float32).eps))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, size)
                    packed = pa.array([r.tobytes() for r in binned(x, edges)], pa.binary())
                    scores = pa.array([prior.tobytes()] * batch.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("label"), packed, scores], names=["label", "bins", "scores"])

        rows = checkpointed(vectors.mapInArrow(cut, "label int, bins binary, scores binary"), "boosting")
        rounds = grow(rows, classes, size, bins, self.getOrDefault(self.maxIter), depth)
        packed = {
            "edges": edges, "prior": prior.tolist(), "depth": depth,
            "rounds": [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees] for trees in rounds],
        }
        return BoostedModel(
            featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
            predictionCol=self.getOrDefault(self.predictionCol), trees=json.dumps(packed),
        )


class BoostedModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the class of the highest score; of equal ones the first."""

    trees = Param(Params._dummy(), "trees", "edges, priors and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", trees="{}"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", trees="{}")
        self._set(**self._input_kwargs)

    def rounds(self) -> tuple[list, np.ndarray, list[list[Tree]]]:
        """Bin edges, priors and trees."""
        packed = json.loads(self.getOrDefault(self.trees))
        rounds = []
        for trees in packed["rounds"]:
            made = []
            for feature, cut, value in trees:
                tree = Tree(packed["depth"])
                tree.feature, tree.cut, tree.value = np.array(feature, np.int32), np.array(cut, np.int32), np.array(value)
                made.append(tree)
            rounds.append(made)
        return packed["edges"], np.array(packed["prior"]), rounds

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.rounds())

        @F.pandas_udf("double")
        def predicted(vectors: pd.Series) -> pd.Series:
            edges, prior, rounds = shared.value
            if not len(vectors):
                return pd.Series([], dtype="float64")
            x = binned(np.stack(vectors.to_numpy()), edges)
            scores = raw_scores(rounds, x, np.tile(prior, (len(x), 1)))
            return pd.Series(scores.argmax(axis=1).astype("float64"))

        found = predicted(vector_to_array(self.getOrDefault(self.featuresCol)))
        return dataset.withColumn(self.getOrDefault(self.predictionCol), found)
