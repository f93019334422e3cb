"""Near duplicates among vectors by iterative quantisation (Gong and Lazebnik) and multi-index tables.

A rotation of the principal components is learnt so that their signs lose little. Vectors whose
codes agree on a segment are candidates, and the original vectors decide. Two vectors at an
angle differ in a bit about as often as the angle is of a half turn, wherever the vectors lie
on the whole: components and rotation are those of the vectors themselves, not of their
distances from a mean.
Tight groups are settled in bulk: vectors within half the angle of one leader all link with
each other, so thousands of near copies need no pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.registry import query, table
from millrace.session import checkpointed


@dataclass
class Rotations:
    """For each length of vectors, matrices from vectors to code bits, one for each code."""

    matrices: dict[int, list[np.ndarray]]
    bits: int
    codes: int

    def of(self, size: int) -> list[np.ndarray]:
        """Those of a length; of one that was not learnt, random rotations that stay the same."""
        if size not in self.matrices:
            rng = np.random.default_rng([size, self.bits])
            turns = [rng.normal(size=(size, min(self.bits, size))) for _ in range(self.codes)]
            return [np.linalg.qr(turn)[0] for turn in turns]
        return self.matrices[size]


def unit(vectors: pa.ListArray) -> list[bytes | None]:
    """Vectors scaled to length 1, as bytes of doubles; none for null, zero and non-finite ones."""
    lists = vectors.cast(pa.list_(pa.float64()))
    counts = lists.value_lengths().fill_null(0).to_numpy()
    out: list[bytes | None] = [None] * len(lists)
    for size in np.unique(counts[counts > 0]).tolist():
        rows = np.flatnonzero(counts == size)
        values = lists.take(pa.array(rows)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
        x = values.reshape(-1, size)
        finite = np.isfinite(x).all(axis=1)
        x = np.where(finite[:, None], x, 0)
        top = np.abs(x).max(axis=1)
        x = x / np.where(top > 0, top, 1)[:, None]
        norms = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(norms > 0, norms, 1)[:, None]
        for row, v, good in zip(rows.tolist(), x, finite & (norms > 0)):
            if good:
                out[row] = v.tobytes()
    return out


def fit(sample: np.ndarray, bits: int, codes: int, rounds: int = 50, seed: int = 11) -> list[np.ndarray]:
    """Alternate between codes and the rotation that fits them best, from a random start per code."""
    _, _, axes = np.linalg.svd(sample.T @ sample)
    project = axes[: min(bits, sample.shape[1])].T
    low = sample @ project
    rng, matrices = np.random.default_rng(seed), []
    for _ in range(codes):
        turn, _ = np.linalg.qr(rng.normal(size=(project.shape[1],) * 2))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        matrices.append(project @ turn)
    return matrices


def encode(matrices: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """One code of up to 64 bits per vector (rows) and matrix (columns), as signed 64-bit numbers."""
    out = []
    for matrix in matrices:
        signs = (x @ matrix) > 0
        weights = np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64)
        out.append((signs * weights).sum(axis=1, dtype=np.uint64).view(np.int64))
    return np.stack(out, axis=1)


def _by_length(*columns: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose vectors in the first column have one length, and the matrices of these vectors."""
    lists = [c.to_pylist() for c in columns]
    sizes = np.array([len(v) // 8 for v in lists[0]], np.int64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, [np.frombuffer(b"".join([held[r] for r in rows]), np.float64).reshape(len(rows), size) for held in lists]


def _cosines(*names: str):
    """Adds ``cosine`` of the binary columns ``x`` and ``y``, of equal length, to the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for rows, (x, y) in _by_length(batch.column("x"), batch.column("y")):
                found[rows] = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(found, pa.float64())], names=[*names, "cosine"]
            )

    return run


def tables_for(vectors: int, bits: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """Width of segments, segments of a code and number of codes for so many vectors.

    A segment of ``w`` bits has about 32 vectors of a value, however many vectors there are,
    and two vectors at the threshold agree on it with the chance ``(1 - angle / pi) ** w``; so
    many segments are taken that one of them agrees with the chance ``recall``.
    """
    width = max(1, min(bits, max(8, round(math.log2(max(vectors, 2))) - 5)))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    segments = max(1, bits // width)
    wanted = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    return width, segments, max(1, -(-wanted // segments))


def linked(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9,
    sample: int = 20_000, bits: int = 64, recall: float = 0.97, lengths: int = 8,
) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` of every row.

    The rotations are learnt on the ``sample`` vectors of smallest id hash of each of the
    ``lengths`` commonest vector lengths (others get random ones); every vector is indexed.
    Equal vectors count as one with copies. Two vectors of one length are candidates when a
    segment of a code agrees and a whole code differs by no more than their angle allows; the
    cosine of the original vectors in double precision decides. Found links are right; a link
    at the threshold is found with the chance ``recall``, one of a smaller angle more surely.

    Null, zero and non-finite vectors and rows without id link with nothing: no links,
    component is their own id. Vectors of different lengths never link. Repeated rows are copies.
    """
    spark = rows.sparkSession
    flat = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = unit(batch.column(1))
            keys = [hashlib.blake2b(d, digest_size=16).digest() if d else None for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "key", "x"]
            )

    named = flat.select("id", F.when(F.col("id").isNotNull(), F.col("v")).alias("v"))
    ready = checkpointed(named.mapInArrow(scaled, "id bigint, key binary, x binary"), "unit")
    good = ready.where("key is not null")
    distinct = checkpointed(
        good.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x")), "distinct"
    )
    size = F.octet_length("x") / 8
    common = distinct.groupBy(size.cast("bigint").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size")
    common = common.limit(lengths).collect()
    if not common:
        return flat.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    # A vector shorter than a code has a bit per component, so fewer segments.
    shortest = min((r["size"] for r in common if r["size"] >= 8), default=bits)
    width, _, codes = tables_for(sum(r["n"] for r in common), min(bits, shortest), threshold, recall)
    segments = max(1, bits // width)
    learnt = {}
    for row in common:
        some = distinct.where(size == row["size"]).orderBy(F.xxhash64("least"), "least", "key").limit(sample).select("x").toArrow()
        (_, (vectors,)), = _by_length(some.column("x").combine_chunks())
        learnt[row["size"]] = fit(vectors, bits, codes)
    shared = spark.sparkContext.broadcast(Rotations(learnt, bits, codes))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, codes), np.int64)
            for at, (x,) in _by_length(batch.column("x")):
                found[at] = encode(shared.value.of(x.shape[1]), x)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * codes), pa.array(found.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "codes"])

    nodes = checkpointed(
        distinct.mapInArrow(coded, "key binary, least bigint, copies bigint, x binary, codes array<bigint>"), "nodes"
    )
    # A slot is a length, a code and a segment of it; the value are the segment's bits.
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint")
    slots = [
        F.when(
            F.lit(n == 0) | (size >= (n + 1) * width),
            F.struct(
                (size.cast("bigint") * (codes * segments) + (c * segments + n)).alias("slot"),
                F.shiftrightunsigned(F.col("codes")[c], n * width).bitwiseAND(mask).alias("value"),
            ),
        )
        for c in range(codes)
        for n in range(segments)
    ]
    entries = nodes.select("key", F.explode(F.array_compact(F.array(*slots))).alias("e"))
    index = checkpointed(entries.select("key", "e.slot", "e.value"), "index")

    # Leaders: vectors within half the angle of the same leader are within the whole of each other.
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    vectors = nodes.select("key", "x")

    def near(pairs: DataFrame) -> DataFrame:
        other = vectors.select(F.col("key").alias("leader"), F.col("x").alias("y"))
        found = pairs.join(vectors, "key").join(other, "leader").select("key", "leader", "x", "y")
        found = found.mapInArrow(_cosines("key", "leader"), "key binary, leader binary, cosine double")
        return checkpointed(found.where(F.col("cosine") >= half), "near")

    stars = checkpointed(
        index.groupBy("slot", "value").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1"), "stars"
    )
    known = near(index.join(stars, ["slot", "value"]).where("key != leader").select("key", "leader").distinct())
    for _ in range(2):
        first = checkpointed(known.groupBy("key").agg(F.min("leader").alias("top")), "first")
        further = known.join(first.select(F.col("key").alias("leader"), "top"), "leader").where("key != top")
        further = further.select("key", F.col("top").alias("leader")).distinct()
        known = known.unionByName(near(further.join(known, ["key", "leader"], "left_anti")))
    best = known.groupBy("key").agg(F.min(F.struct("leader", "cosine")).alias("b"))
    best = checkpointed(best.select("key", F.col("b.leader").alias("leader"), F.col("b.cosine").alias("cosine")), "best")
    groups = checkpointed(
        nodes.select("key", "least", "copies", "codes")
        .join(best, "key", "left")
        .withColumn("core", F.coalesce("leader", "key"))
        .withColumn("cosine", F.coalesce("cosine", F.lit(1.0))),
        "groups",
    )
    # A leader with a leader of its own is in that one's core; both cores meet below. Only a core
    # that is its own single member (``own``) may be judged by its centre's code and cosine.
    cores = checkpointed(
        groups.groupBy("core").agg(
            F.sum("copies").alias("total"), F.count("*").alias("n"), F.min("cosine").alias("edge"), F.min("least").alias("least"),
            ((F.count("*") == 1) & F.bool_and(F.col("key") == F.col("core"))).alias("own"),
        ).join(nodes.select(F.col("key").alias("core"), "x", "codes"), "core"),
        "cores",
    )

    # Candidates between cores: a core shows up once under each value its members have.
    theta = math.acos(threshold)

    def angle(c: str):
        return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c))))

    centres = cores.select("core", "codes", angle("edge").alias("spread"))
    mine = index.join(groups.select("key", "core"), "key").select("core", "slot", "value").distinct().join(centres, "core")
    mine = checkpointed(mine, "mine")
    # Members that link leave their centres at most this angle apart, hence so many bits, give or take four times their deviation.
    apart = [F.bit_count(F.col("p.codes")[c].bitwiseXOR(F.col("i.codes")[c])) for c in range(codes)]
    share = (F.col("p.spread") + F.col("i.spread") + theta) / math.pi
    reach = share * bits + 4 * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) * bits)
    pairs = mine.alias("p").join(
        mine.alias("i"),
        (F.col("p.slot") == F.col("i.slot")) & (F.col("p.value") == F.col("i.value")) & (F.col("p.core") < F.col("i.core"))
        & ((F.least(*apart) if codes > 1 else apart[0]) <= reach),
    ).select(F.col("p.core").alias("a"), F.col("i.core").alias("b"))
    handed = best.join(groups.select(F.col("key").alias("leader"), F.col("core").alias("above")), "leader").where(
        "leader != above"
    ).select(F.least("leader", "above").alias("a"), F.greatest("leader", "above").alias("b"))
    pairs = pairs.unionByName(handed).distinct()
    left = cores.select(F.col("core").alias("a"), "x", F.col("edge").alias("edge_a"), F.col("own").alias("own_a"))
    right = cores.select(F.col("core").alias("b"), F.col("x").alias("y"), F.col("edge").alias("edge_b"), F.col("own").alias("own_b"))
    names = ["a", "b", "edge_a", "edge_b", "own_a", "own_b"]
    met = checkpointed(
        pairs.join(left, "a").join(right, "b").select(*names, "x", "y").mapInArrow(
            _cosines(*names), "a binary, b binary, edge_a double, edge_b double, own_a boolean, own_b boolean, cosine double"
        ),
        "met",
    )
    between, reach_of = angle("cosine"), angle("edge_a") + angle("edge_b")
    single = F.col("own_a") & F.col("own_b")
    all_of = F.when(single, F.col("cosine") >= threshold).otherwise(between + reach_of <= theta - 1e-9)
    whole = met.where(all_of).select("a", "b")
    mixed = met.where(~all_of & ~single & (between - reach_of <= theta + 1e-9)).select("a", "b")
    members = groups.select("key", "core", "least").join(nodes.select("key", "x", "copies"), "key")
    ours = members.select(F.col("core").alias("a"), F.col("key").alias("m"), "x", F.col("copies").alias("copies_m"))
    theirs = members.select(F.col("core").alias("b"), F.col("key").alias("o"), F.col("x").alias("y"), F.col("copies").alias("copies_o"))
    fields = ["a", "b", "m", "o", "copies_m", "copies_o"]
    single_links = checkpointed(
        mixed.join(ours, "a").join(theirs, "b").select(*fields, "x", "y").mapInArrow(
            _cosines(*fields), "a binary, b binary, m binary, o binary, copies_m bigint, copies_o bigint, cosine double"
        ).where(F.col("cosine") >= threshold).drop("cosine"),
        "links",
    )
    totals = cores.select("core", "total")
    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bulk = both.join(totals.withColumnRenamed("core", "b"), "b").groupBy(F.col("a").alias("core")).agg(F.sum("total").alias("bulk"))
    each = single_links.select(F.col("m").alias("key"), F.col("copies_o").alias("n")).unionByName(
        single_links.select(F.col("o").alias("key"), F.col("copies_m").alias("n"))
    ).groupBy("key").agg(F.sum("n").alias("each"))
    edges = checkpointed(whole.unionByName(single_links.select("a", "b")).distinct(), "core-edges")
    if edges.isEmpty():
        roots = cores.select("core", "least")
    else:
        reached = checkpointed(components(edges, "a", "b"), "components")
        of = cores.select("core", "least").join(reached.withColumnRenamed("node", "core"), "core", "left")
        of = checkpointed(of.withColumn("component", F.coalesce("component", "core")), "of")
        low = of.groupBy("component").agg(F.min("least").alias("low"))
        roots = of.join(low, "component").select("core", F.col("low").alias("least"))
    counted = (
        groups.select("key", "core").join(totals, "core").join(bulk, "core", "left").join(each, "key", "left")
        .join(roots, "core")
        .select(
            "key",
            (F.col("total") - 1 + F.coalesce("bulk", F.lit(0)) + F.coalesce("each", F.lit(0))).cast("bigint").alias("n_links"),
            F.col("least").alias("component_id"),
        )
    )
    counted = checkpointed(counted, "counted")
    found = good.select("id", "key").join(counted, "key").select("id", "n_links", "component_id")
    rest = ready.where("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(rest)


@query("op10_itq")
def itq(spark, sf_dir):
    """Links and component of every vector at a cosine of at least 0.9."""
    found = linked(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
