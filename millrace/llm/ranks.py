"""Places of rows in one order over the whole table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

_PIECE = "__piece"


def numbered(rows: DataFrame, order: Sequence[Column], out: str = "at", label: str = "numbered") -> DataFrame:
    """``rows`` with ``out``, their place from 0 in ``order``.

    Rows are dealt to ranges of the order and written with the number of their range; every
    range counts its rows, and only those counts are summed along. Equal rows get
    neighbouring places. Rows should be narrow: they are written once and moved twice.
    """
    order = list(order)
    placed = checkpointed(rows.repartitionByRange(*order).withColumn(_PIECE, F.spark_partition_id()), label)
    before = Window.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(_PIECE).agg(F.count("*").alias("__n")).select(
        _PIECE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(_PIECE).orderBy(*order)
    return (
        placed.withColumn("__in", F.row_number().over(inside))
        .join(starts, _PIECE)
        .withColumn(out, (F.col("__start") + F.col("__in") - 1).cast("bigint"))
        .drop(_PIECE, "__in", "__start")
    )
