"""Exact top-k search among binary codes by incremental multi-index hashing (Norouzi, Punjani, Fleet).

A code is cut into segments, each with an index from segment value to codes. Two codes within
distance m (r + 1) - 1 agree on one of m segments up to r bits, so after probing all values
within r bits of every segment, nothing nearer is missing. The radius grows until the kth
verified distance is within that bound, for each query on its own.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import query, table
from millrace.session import checkpointed


def folded_code(vector: str | Column, bits: int) -> Column:
    """``bits`` bits of a vector: bit j tells whether the components j, j + bits, ... sum above 0.

    Null and NaN components count as 0; a null vector has no code.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector
    clean = F.transform(vector, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    totals = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda j: F.aggregate(
            F.filter(clean, lambda x, i: i % bits == j), F.lit(0.0), lambda a, x: a + x
        ),
    )
    return F.when(
        vector.isNotNull(),
        F.aggregate(totals, F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)),
    )


def _segment(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda mask: mask.bitwiseXOR(value)))


def search(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    bits: int = 32,
    segments: int | None = None,
    id_column: str = "vec_id",
    code_column: str = "code",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the other row's id and ``distance``: the ``k`` nearest others.

    Both tables have an id and a code of up to 63 bits as bigint; equal distances rank by id.
    A row is no neighbour of a query of its own id. Equal codes are looked up once, with their
    ``k + 1`` smallest ids, which is all that can appear, so thousands of copies cost as much
    as one. Without ``segments`` their width follows the logarithm of the number of codes, so
    that a bucket holds a few codes. Rows without id or code are left out; repeated rows of an
    id rank once; fewer than ``k`` others give fewer rows, an empty index none.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_column).cast("bigint").alias("id"), F.col(code_column).alias("code")).where(
        "id is not null and code is not null"
    )
    small = Window.partitionBy("code").orderBy("id")
    kept = (
        rows.distinct().withColumn("n", F.row_number().over(small)).where(F.col("n") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("least", F.col("ids")[0])
    )
    codes = checkpointed(kept, "codes")
    asked = queries.select(F.col(id_column).cast("bigint").alias("query_id"), F.col(code_column).alias("asked"))
    asked = checkpointed(asked.where("query_id is not null and asked is not null").distinct(), "asked")
    total = codes.count()
    want = min(k + 1, total)
    if segments is None:
        segments = max(2, min(bits // 4, round(bits / max(8.0, math.log2(max(total, 2))))))
    cuts = [bits * n // segments for n in range(segments + 1)]
    parts = list(zip(cuts[:-1], (b - a for a, b in zip(cuts[:-1], cuts[1:]))))

    def pieces(code: Column) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("seg"), _segment(code, a, w).alias("value")) for n, (a, w) in enumerate(parts)])

    lookup = checkpointed(
        codes.select("code", "least", F.explode(pieces(F.col("code"))).alias("p")).select("p.seg", "p.value", "code", "least"),
        "lookup",
    )
    active = asked.select("asked").distinct().withColumn("bound", F.lit(bits))
    best = None
    for radius in range(max(w for _, w in parts) + 1):
        probes = None
        for n, (a, w) in enumerate(parts):
            if radius > w:
                continue
            masks = [sum(1 << b for b in flips) for flips in combinations(range(w), radius)]
            value = _segment(F.col("asked"), a, w)
            some = active.select(
                "asked", "bound", F.lit(n).alias("seg"),
                _flipped(value, masks).alias("value"),
            )
            probes = some if probes is None else probes.unionByName(some)
        differ = F.col("code").bitwiseXOR(F.col("asked"))
        # A code met in several segments counts in the first of those where it is nearest.
        first = F.lit(True)
        for n, (a, w) in enumerate(parts):
            apart = F.bit_count(_segment(differ, a, w))
            first = first & F.when(F.col("p.seg") > n, apart > radius).when(F.col("p.seg") < n, apart >= radius).otherwise(F.lit(True))
        found = (
            probes.alias("p").join(
                lookup.alias("i"),
                (F.col("p.seg") == F.col("i.seg")) & (F.col("p.value") == F.col("i.value"))
                & (F.bit_count(differ) <= F.col("bound")) & first,
            ).select("asked", "code", "least", F.bit_count(differ).alias("distance"))
        )
        merged = found if best is None else best.unionByName(found)
        order = Window.partitionBy("asked").orderBy("distance", "least")
        best = checkpointed(
            merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= want).drop("n"), "best"
        )
        covered = segments * (radius + 1) - 1
        state = best.groupBy("asked").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        active = checkpointed(
            active.select("asked").join(state, "asked", "left")
            .where((F.coalesce("n", F.lit(0)) < want) | (F.col("worst") > covered))
            .select("asked", F.when(F.col("n") >= want, F.col("worst")).otherwise(bits).alias("bound")),
            "active",
        )
        if covered >= bits or active.isEmpty():
            break
    near = best.join(codes.select("code", "ids"), "code").select("asked", "distance", F.explode("ids").alias("id"))
    ranked = asked.join(near, "asked").where("id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (
        ranked.withColumn("rank", place).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_column), F.col("distance").cast("int").alias("distance"))
    )


ORACLE = """
WITH codes AS (
  SELECT vec_id, list_sum([(CASE WHEN embedding[j]::DOUBLE + embedding[j + 32]::DOUBLE > 0 THEN 1 ELSE 0 END)::BIGINT
                           << (32 - j) for j in range(1, 33)])::BIGINT AS code
  FROM embeddings WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id, bit_count(xor(q.code, i.code))::INTEGER AS distance
  FROM codes q JOIN codes i ON q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


@query("op2_multi_index_top_k", ORACLE)
def multi_index_top_k(spark, sf_dir):
    """The ten nearest others of every twentieth vector by the Hamming distance of 32-bit codes."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", folded_code("embedding", 32).alias("code"))
    codes = checkpointed(codes, "vectors")
    return search(codes.where("vec_id % 20 = 0"), codes)
