"""Connected components of a link table, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed


def _settled(edges: DataFrame) -> bool:
    """Whether every node below another has one edge and nothing below itself."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"))
    )).alias("end")).select("end.*")
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return seen.where("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link.

    Every round hangs the neighbours of each node below its smallest neighbour, first the
    larger ones, then the smaller ones, until every node hangs directly below the smallest one;
    rounds grow with the logarithm of the number of nodes. A node with very many links is a hot key of a join that AQE
    splits, never a list. Null ends and loops are ignored.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = checkpointed(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # The smallest neighbour of a node leaves the edge of the node itself.
        above = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
        edges = checkpointed(large.join(low, "u").select(above.alias("u"), F.col("m").alias("v")).distinct(), "edges")
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
