"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every shard scores a key by -weight / ln(u), u in (0, 1) being a hash of key and shard; the
highest score wins. A further shard changes no other score, so keys move only into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import query, table
from millrace.session import checkpointed

SHARDS = 24
_PIECES = 4096


def shard_score(key: str | Column, shard: int, weight: float = 1.0) -> Column:
    """Score of a shard for a key; null keys score as the number -1 hashed twice."""
    key = F.col(key) if isinstance(key, str) else key
    hashed = F.coalesce(F.xxhash64(key), F.lit(0).cast("bigint"))
    bits = F.shiftrightunsigned(F.xxhash64(hashed, F.lit(shard)), 12)
    return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) / float(1 << 52))


def shard_of(key: str | Column, weights: Sequence[float]) -> Column:
    """Shard, from 0, with the highest score; of equal scores the smaller number."""
    scored = [F.struct(shard_score(key, n, w).alias("score"), F.lit(-n).alias("n")) for n, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["n"]).cast("int")


def place(
    rows: DataFrame,
    key_column: str,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``rows`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``.

    Rows of a shard are numbered without gaps from 0, by hash piece, then key, then
    ``order_by``. A shard is cut into pieces by a hash of key and ``order_by``, so neither a
    shard nor a hot key is numbered by one task; only counts of pieces are summed along. Null
    keys are one key; repeated rows get neighbouring slots; columns of the three names are
    replaced.
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "grown_shard", "slot")]
    weights = list(weights)
    extra = F.struct(shard_score(key_column, len(weights), grown_weight).alias("score"), F.lit(-len(weights)).alias("n"))
    scored = [F.struct(shard_score(key_column, n, w).alias("score"), F.lit(-n).alias("n")) for n, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    placed = (
        rows.select(*[F.col(f"`{c}`") for c in columns])
        .withColumn("__best", best)
        .withColumns(
            {
                "shard": (-F.col("__best.n")).cast("int"),
                "grown_shard": (-F.greatest("__best", extra)["n"]).cast("int"),
                "__piece": F.pmod(F.xxhash64(key_column, *order_by), F.lit(_PIECES)).cast("int"),
            }
        )
        .drop("__best")
    )
    placed = checkpointed(placed, "placed")
    counts = placed.groupBy("shard", "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(
        counts.select("shard", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "starts"
    )
    inside = Window.partitionBy("shard", "__piece").orderBy(key_column, *order_by)
    return (
        placed.join(starts, ["shard", "__piece"])
        .withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1)
        .select(*[F.col(f"`{c}`") for c in columns], "shard", "slot", "grown_shard")
    )


@query("op3_rendezvous")
def rendezvous(spark, sf_dir):
    """Shard and slot of every document; the id and the number of shards decide."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    return place(sized, "doc_id", order_by=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
