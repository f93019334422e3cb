"""Order-dependent columns that stay spread out when one key holds most rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the order
column is an integer that is unique within its key, so ``shiftright(order, bits)`` cuts a
key into slices of at most ``2**bits`` rows. Windows run inside a slice; what a slice
needs from its neighbours is one row per slice, computed with a partial aggregate.

Orders far apart (timestamps) make many slices of few rows each, so slices are cut once more
into blocks of ``2**bits`` slices, and what one block needs from the others is one row per
block. A key of microsecond timestamps has some 2,000 blocks, the widest 64-bit range 2**24.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 20

_SLICE = "__slice"
_BLOCK = "__block"
_CARRY = "__carry"


def _sliced(df: DataFrame, order: str, bits: int) -> DataFrame:
    return df.withColumn(_SLICE, F.shiftright(F.col(order).cast("bigint"), bits))


def _with_carry(sliced: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sliced.join(carry, [*keys, _SLICE], "left")


def _blocked(slices: DataFrame, bits: int) -> DataFrame:
    return slices.withColumn(_BLOCK, F.shiftright(_SLICE, bits))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bits: int = SLICE_BITS
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    keys = list(keys)
    sliced = _sliced(df.withColumn(out, value), order, bits)
    totals = _blocked(sliced.groupBy(*keys, _SLICE).agg(F.sum(out).alias("__total")), bits)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy(*keys, _BLOCK).agg(F.sum("__total").alias("__sum"))
    blocks = blocks.select(*keys, _BLOCK, F.sum("__sum").over(before).alias("__base"))
    earlier = Window.partitionBy(*keys, _BLOCK).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0)
    carry = (
        totals.withColumn(_CARRY, F.sum("__total").over(earlier))
        .join(blocks, [*keys, _BLOCK], "left")
        .select(
            *keys, _SLICE,
            (F.coalesce(_CARRY, nothing) + F.coalesce("__base", nothing)).alias(_CARRY),
        )
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _with_carry(sliced.withColumn(out, F.sum(out).over(inside)), carry, keys)
        .withColumn(out, F.col(out) + F.coalesce(F.col(_CARRY), F.lit(0)))
        .drop(_SLICE, _CARRY)
    )


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    before: str | None = None,
    after: str | None = None,
    bits: int = SLICE_BITS,
) -> DataFrame:
    """Nearest non-null ``value`` up to this row (``before``) and from it on (``after``).

    Each named output is a struct of the row's order ``at`` and its ``value``, or null. Both
    directions share one shuffle of the rows.
    """
    keys = list(keys)
    sliced = _sliced(df, order, bits)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    whole, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, _SLICE)
    block = Window.partitionBy(*keys, _BLOCK)
    edges, outer, bases, nearer, carries, fills = [], [], [], [], [], {}
    # Both are running frames, the second on descending rows: a frame from the current row to
    # the end would be read again for every row.
    for out, name, at, pick, down in (
        (before, "last", F.max, F.max_by, False),
        (after, "first", F.min, F.min_by, True),
    ):
        if not out:
            continue

        def sort(c: str, down: bool = down):
            return F.col(c).desc() if down else F.col(c).asc()

        edges += [at(known).alias(f"__{name}_at"), pick(value, known).alias(f"__{name}")]
        edge = F.when(
            F.col(f"__{name}_at").isNotNull(),
            F.struct(F.col(f"__{name}_at").alias("at"), F.col(f"__{name}").alias("value")),
        )
        outer += [
            at(f"__{name}_at").alias(f"__{name}_at"), pick(f"__{name}", f"__{name}_at").alias(f"__{name}")
        ]
        frame = Window.unboundedPreceding, -1
        bases.append(
            F.last(edge, ignorenulls=True).over(whole.orderBy(sort(_BLOCK)).rowsBetween(*frame)).alias(f"__base_{name}")
        )
        nearer.append(
            F.last(edge, ignorenulls=True).over(block.orderBy(sort(_SLICE)).rowsBetween(*frame)).alias(f"__near_{name}")
        )
        carries.append(F.coalesce(f"__near_{name}", f"__base_{name}").alias(f"{_CARRY}_{name}"))
        running = inside.orderBy(sort(order)).rowsBetween(Window.unboundedPreceding, 0)
        fills[out] = F.last(here, ignorenulls=True).over(running), f"{_CARRY}_{name}"
    slices = _blocked(sliced.groupBy(*keys, _SLICE).agg(*edges), bits)
    blocks = slices.groupBy(*keys, _BLOCK).agg(*outer).select(*keys, _BLOCK, *bases)
    carry = (
        slices.select(*keys, _SLICE, _BLOCK, *nearer)
        .join(blocks, [*keys, _BLOCK], "left")
        .select(*keys, _SLICE, *carries)
    )
    filled = sliced.withColumns({out: column for out, (column, _) in fills.items()})
    return (
        _with_carry(filled, carry, keys)
        .withColumns({out: F.coalesce(F.col(out), F.col(c)) for out, (_, c) in fills.items()})
        .drop(_SLICE, *[c for _, c in fills.values()])
    )


def next_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    out: str,
    bits: int = SLICE_BITS,
) -> DataFrame:
    """Struct of ``columns`` taken from the following row of the same key, else null."""
    keys = list(keys)
    sliced = _sliced(df.withColumn(out, F.struct(*columns)), order, bits)
    heads = _blocked(sliced.groupBy(*keys, _SLICE).agg(F.min_by(out, order).alias("__head")), bits)
    blocks = heads.groupBy(*keys, _BLOCK).agg(F.min_by("__head", _SLICE).alias("__head"))
    following = F.lead("__head").over(Window.partitionBy(*keys).orderBy(_BLOCK))
    nearer = F.lead("__head").over(Window.partitionBy(*keys, _BLOCK).orderBy(_SLICE))
    carry = (
        heads.withColumn(_CARRY, nearer)
        .join(blocks.select(*keys, _BLOCK, following.alias("__next")), [*keys, _BLOCK], "left")
        .select(*keys, _SLICE, F.coalesce(_CARRY, "__next").alias(_CARRY))
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(order)
    return (
        _with_carry(sliced.withColumn(out, F.lead(out).over(inside)), carry, keys)
        .withColumn(out, F.coalesce(F.col(out), F.col(_CARRY)))
        .drop(_SLICE, _CARRY)
    )
