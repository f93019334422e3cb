"""Toxic texts by a convolutional classifier over hashed words, written in numpy.

A word is two rows of a hashed embedding table side by side, so a wrong match needs two
collisions at once. Filters of widths 1, 2 and 3 slide over the whole text, their largest
activations feed a logistic unit. The decision threshold is set per language on rows kept out
of the fit; the language is read off the function words of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordered import next_row, running_sum
from millrace.llm.registry import query, table
from millrace.llm.words import blocks, mix, release, word_hashes
from millrace.session import checkpointed, shuffles_removed, workspace

WIDTHS = (1, 2, 3)

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was it as are this be by at an",
    "fr": "le la les des et est dans que pour une sur pas qui du au par",
    "de": "der die das und ist nicht ein zu den mit von auf für im dem sich",
    "es": "el los las del que y en un por con una para es se lo como",
}


def _hash_of(words: list[str]) -> np.ndarray:
    column = pa.array([" ".join(words)])
    (_, _, data, offsets), = blocks(column)
    return word_hashes(data, offsets)[0]


@dataclass
class Model:
    """Parameters of the classifier; ``thresholds`` are logits, the first for an unknown language."""

    bits: int
    tables: tuple[np.ndarray, np.ndarray]
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    thresholds: np.ndarray

    def constant(self) -> bool:
        return not len(self.weights)


def buckets(words: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both table rows of every word, texts padded by empty words, and where texts begin."""
    pad = max(WIDTHS)
    begin = first[:-1] - first[0] + pad * np.arange(len(first) - 1)
    size = len(words) + pad * (len(first) - 1)
    one, two = np.full(size, 1 << bits, np.int64), np.full(size, 1 << bits, np.int64)
    at = np.arange(len(words)) + pad * np.repeat(np.arange(len(first) - 1), np.diff(first))
    one[at] = (words >> np.uint64(64 - bits)).astype(np.int64)
    two[at] = (mix(words + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)
    return one, two, begin


def languages(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the language (from 1) with most function words in each text, 0 if there are none."""
    known = {int(h): n for n, v in enumerate(FUNCTION_WORDS.values(), 1) for h in _hash_of(v.split())}
    keys = np.array(sorted(known), np.uint64)
    of = np.array([known[int(k)] for k in keys])
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    named = np.where(keys[at] == words, of[at], 0)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    width = len(FUNCTION_WORDS) + 1
    counts = np.bincount(text * width + named, minlength=width * (len(first) - 1)).reshape(-1, width)
    counts[:, 0] = 0
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), 0)


def _activations(model: Model, one: np.ndarray, two: np.ndarray, width: int) -> np.ndarray:
    """Filter outputs at every place of the padded texts (the last ``width - 1`` are cut)."""
    x = np.concatenate([model.tables[0][one], model.tables[1][two]], axis=1)
    size = len(x) - width + 1
    total = x[:size] @ model.filters[width][0]
    for j in range(1, width):
        total += x[j : j + size] @ model.filters[width][j]
    return total + model.biases[width]


def logits(model: Model, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    one, two, begin = buckets(words, first, model.bits)
    # No filter starts after the last word of a text; an empty text has one all the same.
    padding = np.ones(len(one), bool)
    padding[np.arange(len(words)) + max(WIDTHS) * np.repeat(np.arange(len(begin)), np.diff(first))] = False
    padding[begin] = False
    pooled = []
    for w in WIDTHS:
        act = _activations(model, one, two, w)
        act[padding[: len(act)]] = 0
        pooled.append(np.maximum(np.maximum.reduceat(act, begin, axis=0), 0))
    return (np.concatenate(pooled, axis=1) @ model.weights + model.offset).astype(np.float32)


def scores(model: Model, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability-like score of every text; 0.5 is the threshold of its language."""
    if model.constant():
        return np.full(len(first) - 1, model.offset)
    z = logits(model, words, first) - model.thresholds[languages(words, first)]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _threshold(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Logit with the least weighted error, in the middle of the gap between its neighbours."""
    order = np.argsort(z)
    z, label, weight = z[order], label[order], weight[order]
    misses = np.concatenate([[0], np.cumsum(weight * (label == 1))])
    alarms = np.concatenate([[0], np.cumsum((weight * (label == 0))[::-1])])[::-1]
    cost = misses + alarms
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    low = np.concatenate([[z[0] - 2], z])[best]
    high = np.concatenate([z, [z[-1] + 2]])[best]
    widest = int(np.argmax(high - low))
    return float((low[widest] + high[widest]) / 2)


def bucket_counts(words: np.ndarray, first: np.ndarray, labels: np.ndarray, bits: int) -> np.ndarray:
    """Number of texts that have each bucket, by table, label and bucket."""
    text = np.repeat(np.arange(len(labels)), np.diff(first))
    out = np.zeros((2, 2, (1 << bits) + 1), np.int64)
    for n, h in enumerate((words, mix(words + np.uint64(1)))):
        pairs = np.unique(text << bits | (h >> np.uint64(64 - bits)).astype(np.int64))
        for label in (0, 1):
            own = pairs[labels[pairs >> bits] == label] & ((1 << bits) - 1)
            out[n, label] = np.bincount(own, minlength=out.shape[2])
    return out


def start(seen: np.ndarray, sizes: np.ndarray, bits: int, size: int, count: int, rng: np.random.Generator) -> Model:
    """A model whose embeddings hold the smoothed log odds of their bucket; the rest is random."""
    tables = tuple(rng.normal(0, 0.05, ((1 << bits) + 1, size)).astype(np.float32) for _ in range(2))
    for target, (zero, one) in zip(tables, seen):
        odds = np.log((one + 0.5) / (sizes[1] + 1)) - np.log((zero + 0.5) / (sizes[0] + 1))
        target[:, 0] = np.clip(odds * ((zero + one) / (zero + one + 3)), -3, 3) / 3
        target[-1] = 0
    filters = {w: rng.normal(0, 0.1, (w, 2 * size, count)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][rng.integers(0, w), [0, size], :] += 0.5
    biases = {w: np.full(count, -0.2, np.float32) for w in WIDTHS}
    return Model(
        bits, tables, filters, biases, rng.normal(0.5, 0.1, count * len(WIDTHS)).astype(np.float32), -0.5,
        np.zeros(len(FUNCTION_WORDS) + 1),
    )


def fresh_memory(model: Model) -> dict:
    """What Adagrad knows before the first step."""
    return {
        "tables": tuple(np.full(len(t), 1e-2, np.float32) for t in model.tables),
        "filters": {w: np.full_like(f, 1e-2) for w, f in model.filters.items()},
        "biases": {w: np.full_like(f, 1e-2) for w, f in model.biases.items()},
        "weights": np.full_like(model.weights, 1e-2),
        "offset": 1e-2,
    }


def _together(hashed: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(hashed[r]) for r in rows], dtype=np.int64)])
    return (np.concatenate([hashed[r] for r in rows]) if len(rows) else np.zeros(0, np.uint64)), first


def descend(
    model: Model, state: dict, hashed: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator,
    passes: int, batch: int = 64, rate: float = 0.1,
) -> None:
    """``passes`` over whole texts, in place, with Adagrad."""
    tables, filters, biases = model.tables, model.filters, model.biases
    size, count, pad = tables[0].shape[1], len(biases[WIDTHS[0]]), max(WIDTHS)
    for _ in range(passes):
        for rows in np.array_split(rng.permutation(len(hashed)), max(1, len(hashed) // batch)):
            words, first = _together(hashed, rows)
            one, two, begin = buckets(words, first, model.bits)
            y = labels[rows].astype(np.float32)
            places, pooled = {}, []
            for w in WIDTHS:
                act = _activations(model, one, two, w)
                ends = np.append(begin[1:], len(one))
                at = np.stack([b + act[b : max(b + 1, e - pad)].argmax(axis=0) for b, e in zip(begin, ends)])
                places[w] = at
                pooled.append(np.maximum(act[at, np.arange(count)], 0))
            x = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.offset, -30, 30)))
            error = ((p - y) / len(rows)).astype(np.float32)
            grad = error[:, None] * model.weights[None, :] * (x > 0)
            g = x.T @ error + 1e-4 * model.weights
            state["weights"] += g * g
            model.weights -= rate * g / np.sqrt(state["weights"])
            g = float(error.sum())
            state["offset"] += g * g
            model.offset -= rate * g / np.sqrt(state["offset"])
            for n, w in enumerate(WIDTHS):
                own = grad[:, n * count : (n + 1) * count]
                step_f = np.zeros_like(filters[w])
                for j in range(w):
                    at = places[w] + j
                    x_at = np.concatenate([tables[0][one[at]], tables[1][two[at]]], axis=2)
                    step_f[j] = np.einsum("rf,rfd->df", own, x_at)
                    back = own[:, :, None] * filters[w][j].T[None]
                    for half, (target, memory, ids) in enumerate(
                        zip(tables, state["tables"], (one[at], two[at]))
                    ):
                        flat = ids.ravel()
                        piece = back[:, :, half * size : (half + 1) * size].reshape(-1, size)
                        live = np.abs(piece).sum(axis=1) > 0
                        unique, inverse = np.unique(flat[live], return_inverse=True)
                        if not len(unique):
                            continue
                        total = np.zeros((len(unique), size), np.float32)
                        np.add.at(total, inverse, piece[live])
                        memory[unique] += (total * total).mean(axis=1)
                        target[unique] -= rate * total / np.sqrt(memory[unique])[:, None]
                        target[-1] = 0
                state["filters"][w] += step_f * step_f
                filters[w] -= rate * step_f / np.sqrt(state["filters"][w])
                g = own.sum(axis=0)
                state["biases"][w] += g * g
                biases[w] -= rate * g / np.sqrt(state["biases"][w])


def constant(share: float, bits: int = 17) -> Model:
    """What is known without rows of both labels."""
    return Model(bits, (), {}, {}, np.zeros(0), float(share), np.zeros(len(FUNCTION_WORDS) + 1))


def fit(
    texts: list[str],
    labels: np.ndarray,
    calibrate: np.ndarray,
    share: float,
    bits: int = 17,
    size: int = 8,
    count: int = 8,
    epochs: int = 6,
    steps: int = 400,
    batch: int = 64,
    rate: float = 0.1,
    seed: int = 7,
) -> Model:
    """Train on texts at hand; :func:`learn` does the same on a table. ``share`` is that of label 1 outside of them.

    There are ``epochs`` passes, or as many as make ``steps`` steps. Rows marked in ``calibrate``
    only set thresholds: one for each language with 20 rows of either label, one over all rows
    for the others. Without rows of both labels the score is ``share``.
    """
    train = np.flatnonzero(~calibrate)
    if len(set(labels[train].tolist())) < 2:
        return constant(share, bits)
    rng = np.random.default_rng(seed)
    hashed = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        words, first = word_hashes(data, offsets)
        hashed += [words[a:b] for a, b in zip(first[:-1], first[1:])]
    seen = bucket_counts(*_together(hashed, train), labels[train], bits)
    model = start(seen, np.bincount(labels[train], minlength=2), bits, size, count, rng)
    passes = max(epochs, -(-steps * batch // len(train)))
    descend(model, fresh_memory(model), [hashed[r] for r in train], labels[train], rng, passes, batch, rate)
    held = np.flatnonzero(calibrate)
    if len(set(labels[held].tolist())) < 2:
        held = train
    z, spoken = [], []
    for rows in np.array_split(held, max(1, len(held) // batch)):
        words, first = _together(hashed, rows)
        z.append(logits(model, words, first))
        spoken.append(languages(words, first))
    z, spoken, label = np.concatenate(z), np.concatenate(spoken), labels[held]
    rate_of = np.bincount(label, minlength=2) / len(label)
    weight = np.where(label == 1, share / rate_of[1], (1 - share) / rate_of[0])
    model.thresholds[:] = _threshold(z, label, weight)
    for n in range(1, len(FUNCTION_WORDS) + 1):
        rows = spoken == n
        if min(np.bincount(label[rows], minlength=2)) >= 20:
            model.thresholds[n] = _threshold(z[rows], label[rows], weight[rows])
    return model


def fold(id_column: str | Column) -> Column:
    """CRC-32 of the id as text, modulo 5; 0 is held out of all learning."""
    return F.crc32(F.col(id_column).cast("string")) % 5


#: Training rows that one task learns from on its own between two merges, and their words at most.
SHARD_ROWS = 4096
_SHARD_WORDS = 1 << 22
#: Rounded to these, changes add up to the same whatever the order.
_UNIT = float(1 << 24)
_PART_BITS = 12


def _listed(model: Model, state: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Per table the embeddings with their memory behind them, and all other numbers in a row."""
    rows = [np.concatenate([t, m[:, None]], axis=1) for t, m in zip(model.tables, state["tables"])]
    few = [model.weights, state["weights"], [model.offset, state["offset"]]]
    for w in WIDTHS:
        few += [x.ravel() for x in (model.filters[w], state["filters"][w], model.biases[w], state["biases"][w])]
    return rows, np.concatenate(few).astype(np.float64)


def _restored(model: Model, rows: list[np.ndarray], few: np.ndarray) -> tuple[Model, dict]:
    """The inverse of :func:`_listed`; shapes are those of ``model``."""
    at = 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return few[at - like.size : at].reshape(like.shape).astype(np.float32)

    weights, memory = take(model.weights), take(model.weights)
    offset, offset_memory = few[at : at + 2].tolist()
    at += 2
    filters, biases, state = {}, {}, {"filters": {}, "biases": {}, "weights": memory, "offset": offset_memory}
    for w in WIDTHS:
        filters[w], state["filters"][w] = take(model.filters[w]), take(model.filters[w])
        biases[w], state["biases"][w] = take(model.biases[w]), take(model.biases[w])
    tables = tuple(np.ascontiguousarray(r[:, :-1], np.float32) for r in rows)
    state["tables"] = tuple(r[:, -1].astype(np.float32) for r in rows)
    return Model(model.bits, tables, filters, biases, weights, offset, model.thresholds.copy()), state


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Shard, label and hashed words of every text."""
    for batch in batches:
        shards, marks = batch.column("shard").to_pylist(), batch.column("toxic").to_pylist()
        for begin, _, data, offsets in blocks(batch.column("text")):
            words, first = word_hashes(data, offsets)
            for n, (a, b) in enumerate(zip(first[:-1], first[1:]), begin):
                yield shards[n], marks[n], words[a:b]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """The texts of a shard together; very many words are cut into several."""
    held: list[np.ndarray] = []
    marks: list[int] = []
    size, last = 0, None
    for shard, mark, words in _hashed(batches):
        if held and (shard != last or size + len(words) > _SHARD_WORDS):
            yield last, held, np.array(marks, np.int64)
            held, marks, size = [], [], 0
        held.append(words)
        marks.append(mark)
        size, last = size + len(words), shard
    if held:
        yield last, held, np.array(marks, np.int64)


_SUMS = "part int, slots binary, sums binary"


def _sums(part: int, slots: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([slots.astype(np.int32).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([sums.astype(np.int64).tobytes()], pa.binary())], names=["part", "slots", "sums"])


def _cut(slots: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``sums`` by part; ``slots`` ascend."""
    parts = slots >> _PART_BITS
    edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield _sums(int(parts[a]), slots[a:b], sums[a:b])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the rows of equal part and slot."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for part, slots, sums in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.frombuffer(slots, np.int32).astype(np.int64)
            sums = np.frombuffer(sums, np.int64).reshape(len(at), -1)
            if part not in totals:
                totals[part] = np.zeros((1 << _PART_BITS, sums.shape[1]), np.int64)
            totals[part][at - (max(part, 0) << _PART_BITS)] += sums
    for part, total in totals.items():
        used = np.flatnonzero(total.any(axis=1))
        yield _sums(part, used + (max(part, 0) << _PART_BITS), total[used])


def _total(partial: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Slots and sums of every part, added up by tasks; their size is that of the model."""
    out = {}
    with shuffles_removed(partial.sparkSession):
        added = partial.repartition("part").mapInArrow(_added, _SUMS).collect()
    for r in added:
        slots = np.frombuffer(r.slots, np.int32)
        out[r.part] = slots, np.frombuffer(r.sums, np.int64).reshape(len(slots), -1)
    return out


def _count_texts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, (1 << bits) + 1), np.int64)
        for _, held, marks in _shards(batches):
            total += bucket_counts(*_together(held, np.arange(len(held))), marks, bits)
        flat = total.transpose(0, 2, 1).reshape(-1, 2)
        used = np.flatnonzero(flat.any(axis=1))
        yield from _cut(used, flat[used])
        release()

    return run


def _round(shared, seed: list[int], passes: int, batch: int):
    """What the shards of a task change, each from the same model: embeddings they touch, and the rest as part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, few = _listed(*shared.value)
        before = np.concatenate(rows)
        total, rest = np.zeros((len(before), before.shape[1] + 1), np.int64), np.zeros(len(few) + 1, np.int64)
        for shard, held, marks in _shards(batches):
            model, state = _restored(shared.value[0], rows, few)
            descend(model, state, held, marks, np.random.default_rng([*seed, shard]), passes, batch)
            now, few_now = _listed(model, state)
            change = np.rint((np.concatenate(now) - before).astype(np.float64) * _UNIT).astype(np.int64)
            total[:, :-1] += change
            total[:, -1] += change.any(axis=1)
            rest += np.append(np.rint((few_now - few) * _UNIT).astype(np.int64), 1)
        if rest[-1]:
            used = np.flatnonzero(total[:, -1])
            yield from _cut(used, total[used])
            yield _sums(-1, np.zeros(1, np.int64), rest[None])
        release()

    return run


def _merged(model: Model, state: dict, found: dict) -> tuple[Model, dict]:
    """Every number moves by the mean of the shards that changed it."""
    rows, few = _listed(model, state)
    edge = len(rows[0])
    every = np.concatenate(rows).astype(np.float64)
    for part, (slots, sums) in found.items():
        if part >= 0:
            every[slots] += sums[:, :-1] / sums[:, -1:] / _UNIT
    rest = found[-1][1][0]
    return _restored(model, [every[:edge], every[edge:]], few + rest[:-1] / rest[-1] / _UNIT)


def _mark(shared):
    """Language, logit, its place in a whole-number order, and label of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in blocks(batch.column("text")):
                words, first = word_hashes(data, offsets)
                z = logits(shared.value, words, first) + np.float32(0)  # no negative zero
                at = z.view(np.int32)
                at = np.where(at < 0, at ^ np.int32(0x7FFFFFFF), at).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(languages(words, first), pa.int32()), pa.array(z.astype(np.float64)), pa.array(at),
                     batch.column("toxic").slice(begin, end - begin)],
                    names=["language", "z", "at", "toxic"],
                )
        release()

    return run


def thresholds(marked: DataFrame, share: float) -> dict[int, float]:
    """Logit with the least weighted error for all rows (0) and each language with 20 rows of either label.

    It lies in the middle of the widest gap that has this error. Rows of ``marked`` have
    ``language``, ``z``, ``at`` and ``toxic``; they are counted and summed along in slices.
    """
    group = F.explode(F.array_distinct(F.array(F.lit(0), "language"))).alias("group")
    counts = marked.select(group, "z", "at", "toxic").groupBy("group", "at").agg(
        F.min("z").alias("z"), F.sum("toxic").alias("ones"), F.count("*").alias("rows")
    )
    counts = checkpointed(counts, "logits")
    found = {
        r.group: r for r in counts.groupBy("group").agg(
            F.min("z").alias("low"), F.sum("ones").alias("ones"), F.sum("rows").alias("rows")
        ).collect()
    }
    rate = found[0].ones / found[0].rows
    one, zero = share / rate, (1 - share) / (1 - rate)
    # Errors beyond those of a threshold below all rows.
    cuts = running_sum(counts, ["group"], "at", F.col("ones") * one - (F.col("rows") - F.col("ones")) * zero, "cost")
    cuts = checkpointed(next_row(cuts, ["group"], "at", ["z"], "above"), "cuts")
    least = {r.group: min(r.cost, 0.0) for r in cuts.groupBy("group").agg(F.min("cost").alias("cost")).collect()}
    limit = F.element_at(F.create_map(*[F.lit(x) for g, c in least.items() for x in (g, c + 1e-9 * found[g].rows)]), F.col("group"))
    high = F.coalesce("above.z", F.col("z") + 2)
    widest = cuts.where(F.col("cost") <= limit).groupBy("group").agg(
        F.max(F.struct((high - F.col("z")).alias("gap"), -F.col("at"), ((high + F.col("z")) / 2).alias("cut"))).alias("best")
    )
    best = {r.group: r.best for r in widest.collect()}
    out = {}
    for n, r in found.items():
        below = least[n] >= -1e-9 * r.rows and (n not in best or best[n].gap <= 2)
        if n == 0 or min(r.ones, r.rows - r.ones) >= 20:
            out[n] = r.low - 1 if below else best[n].cut
    return out


def _met(rows: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` whose ``__id`` may be among ``ids``: most others stay out of the shuffle, by a bitmap of fixed size."""
    place = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << bits))
    words = (
        ids.select(place.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__at & 63 AS int)))").alias("__bits"))
    )
    near = rows.withColumn("__at", place).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word")
    return near.where("(shiftright(__bits, cast(__at & 63 AS int)) & 1) = 1").drop("__at", "__word", "__bits")


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 17,
    size: int = 8, count: int = 8, epochs: int = 6, steps: int = 400, batch: int = 64, seed: int = 7,
) -> Model:
    """Fit a model on every labelled text.

    Only rows outside fold 0 count; fold 1 sets the thresholds. Several labels of an id count
    as the largest; null ids and labels are left out.

    Texts are dealt to shards by hash of the id. In each of ``epochs`` rounds every shard starts from the
    same model and passes over its texts, and the changes are averaged over the shards that
    made them. Few texts are passed over again within a round until all make ``steps`` steps.
    """
    spark = docs.sparkSession
    truth = (
        labels.where(F.col("toxic").isNotNull() & (fold("doc_id") != 0))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    found = {r["__toxic"]: r["n"] for r in truth.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    share = found.get(1, 0) / max(1, sum(found.values()))
    shards = max(1, -(-sum(found.values()) // SHARD_ROWS))
    texts = docs.select(F.col(id_column).alias("__id"), F.lower(F.col(text_column)).alias("text")).where(fold("__id") != 0)
    # Labels and texts meet in the shuffle that deals the shards, so texts are moved once.
    nothing = F.lit(None)
    both = _met(texts, truth).select("__id", "text", nothing.cast("int").alias("__toxic"), F.lit(True).alias("__doc")).unionByName(
        truth.where("__toxic IN (0, 1)").select("__id", nothing.cast("string").alias("text"), "__toxic", F.lit(False).alias("__doc"))
    )
    both = both.withColumn("shard", F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(shards)).cast("int"))
    of_id = Window.partitionBy("shard", "__id").orderBy("text")
    of_id = of_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = both.repartition("shard").withColumn("toxic", F.max("__toxic").over(of_id)).where("__doc AND toxic IS NOT NULL").select(
        (fold("__id") == 1).alias("calibrate"), "shard", "toxic", F.coalesce("text", F.lit("")).alias("text")
    )
    path = workspace(spark, "labelled")
    with shuffles_removed(spark):
        known.write.option("compression", "zstd").parquet(path)
    known = spark.read.schema(known.schema).parquet(path)
    sizes = {(r.calibrate, r.toxic): r["count"] for r in known.groupBy("calibrate", "toxic").count().collect()}
    if not all((False, label) in sizes for label in (0, 1)):
        return constant(share, bits)
    rows = known.where("NOT calibrate").select("shard", "toxic", "text")
    seen = np.zeros((2 * ((1 << bits) + 1), 2), np.int64)
    for slots, sums in _total(rows.mapInArrow(_count_texts(bits), _SUMS)).values():
        seen[slots] = sums
    of_label = np.array([sizes[False, 0], sizes[False, 1]])
    model = start(seen.reshape(2, -1, 2).transpose(0, 2, 1), of_label, bits, size, count, np.random.default_rng(seed))
    state = fresh_memory(model)
    passes = max(1, -(-steps * batch // (epochs * int(of_label.sum()))))
    for n in range(epochs):
        shared = spark.sparkContext.broadcast((model, state))
        changes = _total(rows.mapInArrow(_round(shared, [seed, n], passes, batch), _SUMS))
        model, state = _merged(model, state, changes)
        shared.destroy()  # its file too
    held = known.where("calibrate") if all((True, label) in sizes for label in (0, 1)) else known.where("NOT calibrate")
    shared = spark.sparkContext.broadcast(model)
    marked = held.select("toxic", "text").mapInArrow(_mark(shared), "language int, z double, at bigint, toxic int")
    cuts = thresholds(marked, share)
    shared.destroy()
    model.thresholds[:] = cuts[0]
    for language, cut in cuts.items():
        model.thresholds[language] = cut
    release()
    return model


def score_texts(
    docs: DataFrame, model: Model, text_column: str | Column = "text"
) -> DataFrame:
    """``docs`` with ``toxicity``, the score of each whole text.

    The text alone decides. Null and empty texts get the score of a text without words;
    repeated rows keep their number and score alike. A column that already has the name of the
    score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(f"`{text_column}`") if isinstance(text_column, str) else text_column
    text = F.lower(text).alias("__lower")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("toxicity", "__lower")], text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                found.append(scores(shared.value, *word_hashes(data, offsets)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(found), pa.float64())],
                names=[*batch.schema.names[:-1], "toxicity"],
            )
        release()

    return docs.mapInArrow(run, ", ".join(x for x in (kinds, "toxicity double") if x))


@query("op4_text_cnn")
def text_cnn(spark, sf_dir):
    """Score of every whole text; labels of fold 0 are never learnt."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    found = score_texts(docs.select("doc_id", "text").select("doc_id", F.col("text")), model)
    return found.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
