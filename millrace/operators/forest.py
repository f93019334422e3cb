"""Forests for numbers: a tree's nodes are split by all tasks until their rows fit one, which grows the rest.

Features are cut into bins once, and a row is the list of its bins above the lowest ones, so
columns of ones and zeros cost what their ones do. Tasks add up the bins of nodes too large for
one task, a job a level; then each such node's rows meet in one task, which splits them until
all labels of a node are equal. Trees stay in files; rows meet them there, and the driver sees
the upper nodes only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.boosting import _PART, _Shared, binned
from millrace.session import checkpointed, remove, workspace

BINS = 255
#: A task grows nodes whose rows hold so many listed bins, and scores so many rows of a node.
LOCAL = 1 << 22
ROWS = 1 << 20
#: Cells of the sums of large nodes a job adds up at once.
MAX_CELLS = 1 << 22
#: Columns whose quantiles a job finds at once.
SKETCHES = 8
#: Bytes of rows that trees grown or met at once move between tasks.
MOVED = 2 << 30

_BLOCK = "block long, labels binary, counts binary, entries binary"
_TREE = "tree int, node int, feature binary, cut binary, left binary, value binary"
_LOWER = "tree int, node int, labels binary, weights binary, counts binary, entries binary"
_LARGE = "slot int, weight double, total double, low double, high double, feature int, cut int, left_weight double"


@dataclass
class Bins:
    """Of each listed bin its feature and its place among that feature's bins."""

    size: int
    start: np.ndarray
    feature: np.ndarray
    bin: np.ndarray

    @staticmethod
    def of(edges: list[list[float]]) -> Bins:
        lengths = np.array([len(cuts) for cuts in edges], np.int64)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        feature = np.repeat(np.arange(len(edges)), lengths)
        return Bins(len(edges), start, feature, np.arange(lengths.sum()) - start[feature] + 1)

    def listed(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins above the lowest of all rows, and how many each row has."""
        row, feature = np.nonzero(bins)
        entries = self.start[feature] + bins[row, feature] - 1
        return np.bincount(row, minlength=len(bins)).astype(np.int32), entries.astype(np.int32)

    def matrix(self, counts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(counts), self.size), np.uint8)
        out[np.repeat(np.arange(len(counts)), counts), self.feature[entries]] = self.bin[entries]
        return out


@dataclass
class Nodes:
    """A tree: the children of node ``n`` are ``left[n]`` and the next one, leaves have the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    KINDS = (np.int32, np.int32, np.int64, np.float64)

    @staticmethod
    def leaf(value: float = 0.0) -> Nodes:
        return Nodes(*(np.array([x], kind) for x, kind in zip((-1, 0, 0, value), Nodes.KINDS)))

    def parts(self) -> list[np.ndarray]:
        return [self.feature, self.cut, self.left, self.value]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            node = at[live]
            at[live] = self.left[node] + (bins[live, self.feature[node]] > self.cut[node])
            live = live[self.feature[at[live]] >= 0]
        return at


def bag(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often a tree learns from each row of a block."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, rows)


def chosen(cells, weights, sums, weight, total, bins: Bins):
    """Node, feature and cut of the best split of every node that has one.

    ``cells`` are ``node * bins + bin`` in order, with the weights and sums of labels in them;
    rows in the lowest bin of a feature are what its cells leave of the node's. A split takes most
    off the squared error; of equal ones the first feature and bin count.
    """
    none = np.zeros(0, np.int64)
    if not len(cells):
        return none, none, none
    node, entry = np.divmod(cells, len(bins.feature))
    feature, place = bins.feature[entry], bins.bin[entry]
    run = node * bins.size + feature
    last = np.flatnonzero(np.diff(run, append=-1))
    length = np.diff(last, prepend=-1)
    w, s = np.cumsum(weights), np.cumsum(sums)
    right_w = np.repeat(w[last], length) - w + weights
    right_s = np.repeat(s[last], length) - s + sums
    left_w, left_s = weight[node] - right_w, total[node] - right_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(left_w > 0.5, right_s**2 / right_w + left_s**2 / left_w, -np.inf)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(node)))
    best = np.flatnonzero((gain == top) & (left_w > 0.5))
    best = best[np.unique(node[best], return_index=True)[1]]
    # Rows in bins that no row of the node is in go with the nearer neighbour.
    before = np.where(np.diff(run, prepend=-1) == 0, np.roll(place, 1), 0)
    return node[best], feature[best], (before[best] + place[best] - 1) // 2


def _cells(key, w, s, size: int):
    """Weights and sums of every cell that has rows, in order."""
    if size <= 4 * len(key):
        weights = np.bincount(key, w, size)
        cells = np.flatnonzero(weights)
        return cells, weights[cells], np.bincount(key, s, size)[cells]
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start], np.add.reduceat(w[order], start), np.add.reduceat(s[order], start)


def grown(y, w, counts, entry, bins: Bins, depth: int | None) -> Nodes:
    """The tree of rows with weights: nodes are split until their labels are equal or ``depth`` ends it."""
    row, at, w = np.repeat(np.arange(len(y)), counts), np.zeros(len(y), np.int64), w.astype(float)
    levels, base, count, level = [], 0, 1, 0

    def only(keep):
        nonlocal row, entry, y, w, at
        stay = keep[row]
        row, entry = (np.cumsum(keep) - 1)[row[stay]], entry[stay]
        y, w, at = y[keep], w[keep], at[keep]

    while True:
        weight, total = np.bincount(at, w, count), np.bincount(at, w * y, count)
        feature, cut, left = (np.full(count, x, kind) for x, kind in zip((-1, 0, 0), Nodes.KINDS))
        levels.append((feature, cut, left, total / weight))
        one = np.empty(count)
        one[at] = y
        mixed = np.bincount(at, y != one[at], count) > 0
        if level == depth or not mixed.any():
            break
        only(mixed[at])
        cells = _cells(at[row] * len(bins.feature) + entry, w[row], (w * y)[row], count * len(bins.feature))
        node, best, edge = chosen(*cells, weight, total, bins)
        if not len(node):
            break
        feature[node], cut[node] = best, edge
        left[node] = base + count + 2 * np.arange(len(node))
        own = bins.feature[entry] == feature[at[row]]
        place = np.zeros(len(y), np.int64)
        place[row[own]] = bins.bin[entry[own]]
        rank = np.full(count, -1)
        rank[node] = np.arange(len(node))
        below = 2 * rank[at] + (place > cut[at])
        split = rank[at] >= 0
        at = below
        only(split)
        base, count, level = base + count, 2 * len(node), level + 1
    return Nodes(*(np.concatenate(part) for part in zip(*levels)))


def _packed(nodes: Nodes) -> list[bytes]:
    return [part.astype(kind).tobytes() for part, kind in zip(nodes.parts(), Nodes.KINDS)]


def _unpacked(parts: list[bytes]) -> Nodes:
    return Nodes(*(np.frombuffer(part, kind) for part, kind in zip(parts, Nodes.KINDS)))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    pairs = [pair.split() for pair in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, pairs)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in pairs])


def _blocks(rows: DataFrame, first: str, kind, edges: list[list[float]]) -> DataFrame:
    """Blocks of the rows of ``first`` and the vector ``x``: listed bins, next to the other column's bytes."""
    bins = Bins.of(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, bins.size)
                counts, entries = bins.listed(binned(x, edges))
                other = batch.column(first).to_numpy().astype(kind).tobytes()
                yield _batch([[(task << 32) + n], [other], [counts.tobytes()], [entries.tobytes()]], _BLOCK)

    return rows.select(first, "x").mapInArrow(run, _BLOCK)


def _read(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple]:
    """Block, other column, counts and listed bins of every block."""
    for batch in batches:
        for block, other, counts, entries in zip(*(c.to_pylist() for c in batch.columns)):
            yield block, np.frombuffer(other, kind), np.frombuffer(counts, np.int32), np.frombuffer(entries, np.int32)


def _groups(leaves: np.ndarray, rows: np.ndarray, counts: np.ndarray, entries: np.ndarray) -> Iterator[tuple]:
    """Of each leaf that has any of ``rows``: these, their counts and their listed bins."""
    for leaf in np.unique(leaves[rows]):
        some = rows[leaves[rows] == leaf]
        if len(some) == len(counts):
            yield int(leaf), some, counts, entries
            continue
        mask = np.zeros(len(counts), bool)
        mask[some] = True
        yield int(leaf), some, counts[some], entries[np.repeat(mask, counts)]


class _Grower:
    """Grows the trees of one forest from its blocks."""

    def __init__(self, blocks: DataFrame, edges: list[list[float]], rows: int, listed: int, seed: int, depth: int | None):
        self.blocks, self.bins, self.rows, self.seed, self.depth = blocks, Bins.of(edges), rows, seed, depth
        self.most = max(1, LOCAL // max(1, -(-listed // rows)))
        self.context = blocks.sparkSession.sparkContext
        self.bytes = 32 + 4 * listed // rows

    def upper(self, trees: range) -> tuple[list[Nodes], list[list[int]], set[tuple[int, int]]]:
        """The nodes with too many rows for one task, the depths of all, and leaves that stay whole."""
        parts = [Nodes.leaf().parts() for _ in trees]
        upper = [[p.tolist() for p in part] for part in parts]
        depths, ended = [[0] for _ in trees], set()
        large = [(k, 0) for k in range(len(trees))] if self.rows > self.most else []
        step = max(1, MAX_CELLS // (len(self.bins.feature) + 5))
        while large:
            below = []
            for begin in range(0, len(large), step):
                now = large[begin : begin + step]
                for r in self._sums(trees, upper, now):
                    k, node = now[r.slot]
                    feature, cut, left, value = upper[k]
                    value[node] = r.total / r.weight
                    if r.low == r.high or r.feature < 0 or depths[k][node] == self.depth:
                        ended.add((k, node))
                        continue
                    feature[node], cut[node], left[node] = r.feature, r.cut, len(feature)
                    for weight in (r.left_weight, r.weight - r.left_weight):
                        if weight > self.most:
                            below.append((k, len(feature)))
                        for column, empty in zip(upper[k], (-1, 0, 0, 0.0)):
                            column.append(empty)
                        depths[k].append(depths[k][node] + 1)
            large = below
        return [Nodes(*(np.array(c, kind) for c, kind in zip(u, Nodes.KINDS))) for u in upper], depths, ended

    def _sums(self, trees: range, upper: list, large: list[tuple[int, int]]) -> list:
        """Best split of each large node, from the sums of all tasks."""
        bins, seed, width = self.bins, self.seed, len(self.bins.feature)
        wanted = sorted({k for k, _ in large})
        shared = self.context.broadcast(
            [(trees[k], [np.array(c, t) for c, t in zip(upper[k], Nodes.KINDS)],
              {node: slot for slot, (tree, node) in enumerate(large) if tree == k}) for k in wanted]
        )

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            known = [(tree, Nodes(*parts), slots) for tree, parts, slots in shared.value]
            for block, y, counts, entries in _read(batches, np.float64):
                matrix = bins.matrix(counts, entries)
                for tree, nodes, slots in known:
                    w = bag(seed, tree, block, len(y))
                    leaves = nodes.leaves(matrix)
                    rows = np.flatnonzero((w > 0) & np.isin(leaves, list(slots)))
                    for node, some, c, e in _groups(leaves, rows, counts, entries):
                        wy, own = w[some] * y[some], np.repeat(np.arange(len(some)), c)
                        new = np.concatenate([
                            np.bincount(e, w[some][own], width), np.bincount(e, wy[own], width),
                            [w[some].sum(), wy.sum(), y[some].min(), y[some].max()],
                        ])
                        slot = slots[node]
                        found[slot] = _added(found[slot], new) if slot in found else new
            if found:
                yield _batch([[*found], [v.tobytes() for v in found.values()]], "slot int, data binary")

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for slot, data in zip(*(c.to_pylist() for c in batch.columns)):
                    new = np.frombuffer(data)
                    found[slot] = _added(found[slot], new) if slot in found else new
            rows = []
            for slot, v in found.items():
                w, s, (weight, total, low, high) = v[:width], v[width:-4], v[-4:]
                cells = np.flatnonzero(w)
                node, feature, cut = chosen(cells, w[cells], s[cells], np.array([weight]), np.array([total]), bins)
                if not len(node):
                    rows.append((slot, weight, total, low, high, -1, 0, 0.0))
                    continue
                above = (bins.feature == feature[0]) & (bins.bin > cut[0])
                rows.append((slot, weight, total, low, high, feature[0], cut[0], weight - w[above].sum()))
            if rows:
                yield _batch([*zip(*rows)], _LARGE)

        partial = self.blocks.mapInArrow(summed, "slot int, data binary").repartition("slot")
        out = partial.mapInArrow(reduced, _LARGE).collect()
        shared.unpersist()
        return out

    def grow(self, trees: range, path: str) -> list[Nodes]:
        """Write the lower nodes of some trees, and return their upper ones."""
        upper, depths, ended = self.upper(trees)
        bins, seed, depth = self.bins, self.seed, self.depth
        shared = self.context.broadcast(([u.parts() for u in upper], depths, ended))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, _, ended = shared.value
            upper = [Nodes(*p) for p in parts]
            for block, y, counts, entries in _read(batches, np.float64):
                matrix = bins.matrix(counts, entries) if any(len(u.feature) > 1 for u in upper) else np.zeros((len(y), 1), np.uint8)
                for k, tree in enumerate(trees):
                    w = bag(seed, tree, block, len(y))
                    for node, some, c, e in _groups(upper[k].leaves(matrix), np.flatnonzero(w), counts, entries):
                        # A leaf that stays whole needs its mean only.
                        if (k, node) not in ended:
                            data = y[some], w[some].astype(np.int32), c, e
                            yield _batch([[tree], [node], *([x.tobytes()] for x in data)], _LOWER)

        def made(key: tuple, rows: pa.Table) -> pa.Table:
            joined = (b"".join(c.to_pylist()) for c in rows.columns[2:])
            y, w, counts, entries = (np.frombuffer(b, t) for b, t in zip(joined, (np.float64, np.int32, np.int32, np.int32)))
            tree, node = (x.as_py() for x in key)
            left = None if depth is None else depth - shared.value[1][tree - trees.start][node]
            return pa.Table.from_batches([_batch([[tree], [node], *([p] for p in _packed(grown(y, w, counts, entries, bins, left)))], _TREE)])

        tasks = _tasks(sum(len(u.feature) for u in upper), self.context)
        lower = self.blocks.mapInArrow(dealt, _LOWER).repartition(tasks, "tree", "node")
        rows = lower.groupBy("tree", "node").applyInArrow(made, _TREE)
        if ended:
            whole = [(trees[k], node, *map(bytearray, _packed(Nodes.leaf(upper[k].value[node])))) for k, node in ended]
            rows = rows.unionByName(rows.sparkSession.createDataFrame(whole, _TREE))
        checkpointed(rows, f"trees-{trees.start:06d}", path)
        shared.unpersist()
        return upper


def _tasks(groups: int, context) -> int:
    """More tasks than groups, so that few of them get two, as far as the cluster's cores go."""
    return min(2 * groups, 16 * context.defaultParallelism)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    out[-2], out[-1] = min(a[-2], b[-2]), max(a[-1], b[-1])
    return out


class ForestRegressor(Estimator, _Shared):
    """Means of ``numTrees`` trees on rows drawn with replacement; ``maxDepth`` 0 sets no depth."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the trees", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the drawn rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=300, maxDepth=0, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=300, maxDepth=0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        work, count = workspace(dataset.sparkSession, "forest"), self.getOrDefault(self.numTrees)
        if count < 1:
            raise ValueError(f"a forest has one tree at least, not {count}")
        label = F.col(self.getOrDefault(self.labelCol)).cast("double").alias("label")
        vectors = dataset.select(label, vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"))
        vectors = checkpointed(vectors, "rows", work)
        known = vectors.agg(F.avg("label").alias("mean"), F.count("*").alias("rows"), F.max(F.size("x")).alias("size")).first()
        edges = _edges(vectors, known.size)
        centred = vectors.withColumn("label", F.col("label") - known.mean)
        blocks = checkpointed(_blocks(centred, "label", np.float64, edges), "blocks", work)
        listed = blocks.agg(F.sum(F.length("entries"))).first()[0] // 4
        depth = self.getOrDefault(self.maxDepth) or None
        grower = _Grower(blocks, edges, known.rows, listed, self.getOrDefault(self.seed) % (1 << 63), depth)
        step, upper = max(1, MOVED // (known.rows * grower.bytes)), []
        for begin in range(0, count, step):
            upper += grower.grow(range(begin, min(begin + step, count)), f"{work}/trees")
        for done in ("rows", "blocks"):
            remove(dataset.sparkSession, f"{work}/{done}")
        trees = [[p.tolist() for p in u.parts()] for u in upper]
        return ForestModel(
            featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
            predictionCol=self.getOrDefault(self.predictionCol), folder=f"{work}/trees",
            upper=json.dumps({"edges": edges, "mean": known.mean, "trees": trees}),
        )


def _edges(vectors: DataFrame, size: int) -> list[list[float]]:
    """Quantiles of each feature, and its lowest value, which has a bin of its own however few rows have it.

    Features of two values need no quantiles, whose sketches take memory.
    """
    x = [F.col("x")[j] for j in range(size)]

    def found(features: list[int], most: int, value) -> dict[int, object]:
        rows = [vectors.agg(*[value(j).alias(str(j)) for j in features[n : n + most]]).first() for n in range(0, len(features), most)]
        return {int(name): v for row in rows for name, v in row.asDict().items()}

    ends = found([*range(size)], _PART, lambda j: F.struct(F.min(x[j]).alias("low"), F.max(x[j]).alias("top")))
    inner = found([*range(size)], _PART, lambda j: F.max((x[j] > ends[j].low) & (x[j] < ends[j].top)))
    shares = F.lit([n / BINS for n in range(1, BINS)])
    cuts = found([j for j in inner if inner[j]], SKETCHES, lambda j: F.percentile_approx(x[j], shares, F.lit(20 * BINS)))
    return [
        sorted({e.low, *(v for v in cuts.get(j, ()) if v < e.top)}) if e.low < e.top else []
        for j, e in sorted(ends.items())
    ]


class _Writer(DefaultParamsWriter):
    """Parameters, and the trees beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        _trees(self.sparkSession, self.instance.getOrDefault(self.instance.folder)).write.parquet(f"{path}/trees/all")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return model._set(folder=f"{path}/trees")


def _trees(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_TREE).parquet(f"{folder}/*")


class ForestModel(Model, _Shared, MLReadable, MLWritable):
    """Adds the mean of the trees' values. Rows meet the trees at once, not when the result is read."""

    upper = Param(Params._dummy(), "upper", "edges, mean and upper nodes as JSON", TypeConverters.toString)
    folder = Param(Params._dummy(), "folder", "folder of the trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", upper="{}", folder=""):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", upper="{}", folder="")
        self._set(**self._input_kwargs)

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, work = dataset.sparkSession, workspace(dataset.sparkSession, "forest-scores")
        known = json.loads(self.getOrDefault(self.upper))
        edges, bins = known["edges"], Bins.of(known["edges"])
        upper = [Nodes(*(np.array(c, t) for c, t in zip(tree, Nodes.KINDS))) for tree in known["trees"]]
        rows = checkpointed(dataset.withColumn("__row", F.monotonically_increasing_id()), "rows", work)
        vectors = rows.select("__row", vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"))
        blocks = checkpointed(_blocks(vectors, "__row", np.int64, edges), "blocks", work)
        count, listed = rows.count(), blocks.agg(F.sum(F.length("entries"))).first()[0] or 0
        parts, lower = max(1, -(-count // ROWS)), _trees(spark, self.getOrDefault(self.folder))
        present = lower.select("tree").distinct().count()
        step = max(1, MOVED // max(1, 40 * count + listed))
        for begin in range(0, len(upper), step):
            some = range(begin, min(begin + step, len(upper)))
            met = _met(blocks, lower, [upper[k] for k in some], some, bins, parts)
            checkpointed(met, f"{begin:06d}", f"{work}/sums")
        if upper and count:
            sums = spark.read.schema(_SUMS).parquet(f"{work}/sums/*")
        else:
            sums = spark.createDataFrame([], _SUMS)
        mean = known.get("mean", 0.0)

        def last(table: pa.Table) -> pa.Table:
            ids, values = _totals(table)
            return pa.table({"__row": pa.array(ids), "__value": pa.array(mean + values / max(1, present))})

        found = checkpointed(sums.groupBy("block").applyInArrow(last, "__row long, __value double"), "values", work)
        for done in ("blocks", "sums"):
            remove(spark, f"{work}/{done}")
        name = self.getOrDefault(self.predictionCol)
        return rows.join(found, "__row", "left").withColumn(name, F.col("__value")).drop("__row", "__value")


_SUMS = "block long, ids binary, values binary"
_ROWS = "tree int, node int, part int, block long, ids binary, counts binary, entries binary"


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the blocks and the sums of their values."""
    ids, values = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("values", np.float64)))
    ids, place = np.unique(ids, return_inverse=True)
    return ids, np.bincount(place, values, len(ids))


def _met(blocks: DataFrame, lower: DataFrame, upper: list[Nodes], trees: range, bins: Bins, parts: int) -> DataFrame:
    """Sums of some trees' values by block; a node's rows meet it in pieces of about ``ROWS``."""
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast([u.parts() for u in upper])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = [Nodes(*p) for p in shared.value]
        for block, ids, counts, entries in _read(batches, np.int64):
            matrix = bins.matrix(counts, entries) if any(len(u.feature) > 1 for u in upper) else np.zeros((len(ids), 1), np.uint8)
            part = ((block >> 32) * 31 + (block & 0xFFFFFFFF)) % parts
            for k, tree in enumerate(trees):
                for node, some, c, e in _groups(upper[k].leaves(matrix), np.arange(len(ids)), counts, entries):
                    yield _batch([[tree], [node], [part], [block], [ids[some].tobytes()], [c.tobytes()], [e.tobytes()]], _ROWS)

    def valued(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and nodes.num_rows:
            tree = _unpacked([nodes.column(c)[0].as_py() for c in ("feature", "cut", "left", "value")])
            for row in rows.to_pylist():
                counts, entries = (np.frombuffer(row[c], np.int32) for c in ("counts", "entries"))
                values = tree.value[tree.leaves(bins.matrix(counts, entries))]
                out.append((row["block"], row["ids"], values.tobytes()))
        return pa.Table.from_batches([_batch([*zip(*out)] or [[]] * 3, _SUMS)])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        ids, values = _totals(table)
        return pa.Table.from_batches([_batch([[key[0].as_py()], [ids.tobytes()], [values.tobytes()]], _SUMS)])

    keys = ["tree", "node", "part"]
    tasks = _tasks(sum(len(u.feature) for u in upper) * parts, context)
    left = blocks.mapInArrow(dealt, _ROWS).repartition(tasks, *keys)
    right = lower.where(F.col("tree").between(trees.start, trees.stop - 1))
    right = right.withColumn("part", F.explode(F.array([F.lit(n) for n in range(parts)]))).repartition(tasks, *keys)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(valued, _SUMS)
    return met.groupBy("block").applyInArrow(summed, _SUMS)
