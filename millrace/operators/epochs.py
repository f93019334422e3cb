"""Softmax regression in epochs of mini-batches, with an evaluation and a saved state per epoch.

Rows hold sparse vectors. Every step is one job: tasks add up the gradient over their rows of
a mini-batch, block by block of the weights, a second stage adds the blocks of all tasks, and
the driver takes an Adam step. The weights are all that is broadcast and gathered; their number
is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import remove

#: Weights of all classes together; their broadcasts and sums stay below 128 MB.
MAX_WEIGHTS = 1 << 24
STEPS = 10
RATE, DECAY, FIRST, SECOND = 0.1, 1e-5, 0.9, 0.999
_BLOCKS = 64
_STATE = "epoch int, kind string, part int, data binary, accuracy double, loss double, train_loss double"


@dataclass
class Fitted:
    """Weights of the best epoch (classes x (features + 1), the last column the intercepts) and its history."""

    weights: np.ndarray
    best: dict
    points: list[dict] = field(default_factory=list)


def features_for(classes: int, wanted: int) -> int:
    """Number of features, a power of two, that keeps the weights within their bound."""
    while wanted > 64 and (wanted + 1) * classes > MAX_WEIGHTS:
        wanted //= 2
    return wanted


def mini_batches(rows: DataFrame, folder: str, test: str, steps: int = STEPS) -> None:
    """Write ``label, indices, values`` by part: training rows in ``steps`` of equal share, held-out ones in -1.

    The part of a row comes from a hash of its content, so a restart finds the same batches.
    """
    part = F.when(F.col(test), -1).otherwise(F.pmod(F.xxhash64("label", "indices", "values"), F.lit(steps)).cast("int"))
    rows.select("label", "indices", "values", part.alias("part")).write.partitionBy("part").parquet(folder)


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    indices, values = batch.column("indices"), batch.column("values")
    counts = np.diff(indices.offsets.to_numpy())
    owner = np.repeat(np.arange(batch.num_rows), counts)
    return batch.column("label").to_numpy(), owner, indices.flatten().to_numpy(), values.flatten().to_numpy()


def probabilities(weights: np.ndarray, rows: int, owner: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Class probabilities of sparse rows, one row each."""
    scores = np.empty((rows, len(weights)))
    for c, w in enumerate(weights):
        scores[:, c] = np.bincount(owner, w[index] * value, minlength=rows) + w[-1]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores / scores.sum(axis=1, keepdims=True)


def _gradients(shared):
    """Per block of weights the sum over a task's rows; block -1 has rows and loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        total, rows, loss = np.zeros_like(weights), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            label, owner, index, value = _sparse(batch)
            p = probabilities(weights, len(label), owner, index, value)
            loss -= float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-15)).sum())
            rows += len(label)
            p[np.arange(len(label)), label] -= 1.0
            for c in range(len(weights)):
                total[c, :-1] += np.bincount(index, p[owner, c] * value, minlength=weights.shape[1] - 1)
            total[:, -1] += p.sum(axis=0)
        if rows:
            blocks = np.array_split(total.ravel(), _BLOCKS)
            yield _sums([-1, *range(_BLOCKS)], [np.array([rows, loss]), *blocks])

    return run


def _sums(blocks: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    data = pa.array([np.ascontiguousarray(a, np.float64).tobytes() for a in arrays], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), data], names=["block", "data"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            found = np.frombuffer(data, np.float64)
            totals[block] = totals[block] + found if block in totals else found.copy()
    if totals:
        yield _sums(list(totals), list(totals.values()))


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, right, loss = 0, 0, 0.0
        for batch in batches:
            if batch.num_rows:
                label, owner, index, value = _sparse(batch)
                p = probabilities(shared.value, len(label), owner, index, value)
                rows += len(label)
                right += int((p.argmax(axis=1) == label).sum())
                loss -= float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-15)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (rows, right, loss)], names=["n", "right", "loss"])

    return run


def evaluate(batches: DataFrame, weights: np.ndarray) -> dict:
    """Accuracy and mean log loss of rows; none, none."""
    shared = batches.sparkSession.sparkContext.broadcast(weights)
    sums = batches.mapInArrow(_judged(shared), "n double, right double, loss double").agg(F.sum("n"), F.sum("right"), F.sum("loss")).first()
    shared.unpersist()
    n = sums[0] or 0.0
    return {"accuracy": sums[1] / n if n else 0.0, "eval_loss": sums[2] / n if n else 0.0}


def _step(batch: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Mean gradient, rows and mean loss of a mini-batch."""
    shared = batch.sparkSession.sparkContext.broadcast(weights)
    partial = batch.mapInArrow(_gradients(shared), "block int, data binary").repartition("block")
    found = {r.block: np.frombuffer(r.data, np.float64) for r in partial.mapInArrow(_add_blocks, "block int, data binary").collect()}
    shared.unpersist()
    if -1 not in found:
        return np.zeros_like(weights), 0, 0.0
    rows, loss = found[-1]
    gradient = np.concatenate([found[b] for b in range(_BLOCKS)]).reshape(weights.shape)
    return gradient / rows, int(rows), float(loss / rows)


def fit(
    spark: SparkSession,
    batches: str,
    state: str,
    classes: int,
    features: int,
    epochs: float,
    say: Callable[[str], None] = lambda message: None,
    steps: int = STEPS,
) -> Fitted:
    """Train on :func:`mini_batches`, an evaluation after every epoch; the best epoch's weights are returned.

    Best is the highest held-out accuracy, the earlier epoch on a tie. The weights, the Adam
    sums and the measures of each epoch are written below ``state``; a later call with the same
    folders goes on after the last finished epoch. A part of an epoch trains on that share of
    the batches.
    """
    schema = "label int, indices array<int>, values array<double>, part int"
    rows = spark.read.schema(schema).parquet(batches)
    held_out = rows.where(F.col("part") == -1)
    shape = (classes, features + 1)
    weights, first, second = (np.zeros(shape) for _ in range(3))
    best, points, done = Fitted(weights.copy(), {"epoch": 0, "accuracy": -1.0}), [], 0
    for row, saved in _saved_epochs(spark, state):
        done = row["epoch"]
        points.append(row)
        weights, first, second = (saved[k].reshape(shape).copy() for k in ("weights", "first", "second"))
        if row["accuracy"] > best.best["accuracy"]:
            best = Fitted(weights.copy(), row)
    total = max(1, round(epochs * steps))
    for start in range(done * steps, total, steps):
        losses, seen = [], 0
        for at in range(start, min(start + steps, total)):
            gradient, n, loss = _step(rows.where(F.col("part") == at % steps), weights)
            if not n:
                continue
            seen += n
            losses.append((n, loss))
            gradient += DECAY * weights
            first = FIRST * first + (1 - FIRST) * gradient
            second = SECOND * second + (1 - SECOND) * gradient**2
            rate = RATE * np.sqrt(1 - SECOND ** (at + 1)) / (1 - FIRST ** (at + 1))
            weights = weights - rate * first / (np.sqrt(second) + 1e-8)
        end = min(start + steps, total)
        point = {"step": end, "epoch": -(-end // steps), "loss": sum(n * x for n, x in losses) / max(seen, 1), **evaluate(held_out, weights)}
        _save_epoch(spark, state, point, {"weights": weights, "first": first, "second": second})
        points.append(point)
        say(f"epoch {point['epoch']}: loss {point['loss']:.4f}, held-out accuracy {point['accuracy']:.4f}")
        if point["accuracy"] > best.best["accuracy"]:
            best = Fitted(weights.copy(), point)
    return Fitted(best.weights, best.best, points)


def _save_epoch(spark: SparkSession, state: str, point: dict, arrays: dict[str, np.ndarray]) -> None:
    measures = (point["accuracy"], point["eval_loss"], point["loss"])
    rows = [
        (point["epoch"], kind, part, piece.tobytes(), *measures)
        for kind, array in arrays.items()
        for part, piece in enumerate(np.array_split(array.ravel(), _BLOCKS))
    ]
    path = f"{state}/epoch-{point['epoch']}-step-{point['step']}"
    remove(spark, path)
    spark.createDataFrame(rows, _STATE).coalesce(1).write.parquet(path)


def _saved_epochs(spark: SparkSession, state: str) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Measures and arrays of every finished epoch, in order; an unfinished write has no success file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(state)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    found = sorted((int(n.split("-")[1]), int(n.split("-")[3]), n) for n in names if n.startswith("epoch-"))
    for epoch, step, name in found:
        if not system.exists(hadoop.Path(f"{state}/{name}/_SUCCESS")):
            return
        rows = spark.read.schema(_STATE).parquet(f"{state}/{name}").collect()
        arrays = {
            kind: np.concatenate([np.frombuffer(r.data, np.float64) for r in sorted(rows, key=lambda r: r.part) if r.kind == kind])
            for kind in ("weights", "first", "second")
        }
        one = rows[0]
        yield {"step": step, "epoch": epoch, "loss": one.train_loss, "accuracy": one.accuracy, "eval_loss": one.loss}, arrays
