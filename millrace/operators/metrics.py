"""Streams and tables of training metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ordered import SLICE_BITS, fill

# Keys shown as curves or axes rather than tiles, and the number of tiles.
NOT_TILES = ("time", "step", "loss", "eval_loss")
SERIES = ("loss", "eval_loss")
MAX_TILES = 8


def loss_series(points: DataFrame, keep: Sequence[str] = ("job",)) -> DataFrame:
    """Curve points ``(…, series, x, y)`` of training and evaluation loss, in one scan."""
    curves = F.explode(
        F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("y")) for s in SERIES])
    )
    x = F.coalesce(F.col("step"), F.lit(0)).cast("bigint")
    return (
        points.select(*keep, x.alias("x"), curves.alias("c"))
        .where("c.y IS NOT NULL")
        .select(*keep, "c.series", "x", F.col("c.y").alias("y"))
    )


def metric_entries(points: DataFrame) -> DataFrame:
    """``(job, seq, key, value)`` for every entry of a point's ``metrics`` map."""
    return points.select("job", "seq", F.explode("metrics").alias("key", "value"))


def latest_metrics(entries: DataFrame) -> DataFrame:
    """Newest value and first appearance of every metric of a job; also for streams."""
    shown = entries.where(~F.col("key").isin(list(NOT_TILES)) & F.col("value").isNotNull())
    return shown.groupBy("job", "key").agg(
        F.max_by("value", "seq").alias("value"), F.min("seq").alias("first_seq")
    )


def metric_tiles(latest: DataFrame, final: DataFrame, n: int = MAX_TILES) -> DataFrame:
    """The first ``n`` metrics per job; final values replace the latest ones.

    ``final`` has ``job, key, value, position``; its new keys follow the streamed ones. A
    final value that is not a number hides the metric.
    """
    ended = final.select("job", "key", F.struct("value", "position").alias("end"))
    both = latest.join(ended, ["job", "key"], "full_outer")
    value = F.when(F.col("end").isNotNull(), F.col("end.value")).otherwise(F.col("value"))
    order = Window.partitionBy("job").orderBy(
        F.col("first_seq").asc_nulls_last(), F.col("end.position"), "key"
    )
    return (
        both.withColumn("value", value)
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("tile", F.row_number().over(order))
        .where(F.col("tile") <= n)
        .select("job", "tile", "key", "value")
    )


def nearest_step(
    wanted: DataFrame,
    points: DataFrame,
    key: str = "series",
    bits: int = SLICE_BITS,
) -> DataFrame:
    """For each wanted ``(key, step)`` the point of the series whose step is nearest.

    The earlier point wins a tie. ``points`` has ``key, step, y``; where a step has several
    points the one with the smallest ``y`` is taken. An as-of fill in both directions, not a
    pairing of steps with points.
    """
    asked = wanted.select(key, "step").withColumn("asked", F.lit(True))
    # One row per step keeps every slice of the fill within its bound.
    steps = (
        asked.unionByName(points.select(key, "step", "y"), allowMissingColumns=True)
        .groupBy(key, "step")
        .agg(F.max("asked").alias("asked"), F.min("y").alias("y"))
    )
    near = _closer(F.col("step"), F.col("before"), F.col("after"))
    return (
        fill(steps, [key], "step", "y", "before", "after", bits)
        .where("asked")
        .withColumn("near", near)
        .where("near IS NOT NULL")
        .select(key, "step", F.col("near.at").alias("near_step"), F.col("near.value").alias("near_y"))
    )


def _closer(step: Column, before: Column, after: Column) -> Column:
    take_after = before.isNull() | (after["at"] - step < step - before["at"])
    return F.when(after.isNotNull() & take_after, after).otherwise(before)
