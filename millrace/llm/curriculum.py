"""Mixing sources to target weights along a curriculum that changes with training time.

Each source has a weight and a schedule, a piecewise linear curve over training time from 0
to 1. The integral of the curve up to a time is the share of the source's words that training
has asked for by then. A source's documents form a tape in hash order, read again from its
start when it ends; the place of a document on the tape, put through the inverse of the
integral, is the time at which training meets it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import query, table
from millrace.session import checkpointed

WEIGHTS = (5, 2, 1)
REPEATS = 3

#: Curves of the sources in turn: values at equally spaced times from 0 to 1.
SCHEDULES = ((3.0, 2.0, 1.0), (2.0, 2.0, 2.0), (1.0, 2.0, 3.0))

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def inverse(share: Column, curve: Sequence[float]) -> Column:
    """Time at which the normalised integral of ``curve`` reaches ``share``.

    Within a piece the integral is f x + g x^2 / 2 for the value f at its start and its slope
    g, so x = 2 r / (f + sqrt(f^2 + 2 g r)) for what remains, r. A curve must be positive
    somewhere in every piece.
    """
    step = 1.0 / (len(curve) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(curve[:-1], curve[1:])]
    wanted = share * F.lit(sum(areas))
    out, before = None, 0.0
    for n, area in enumerate(areas):
        slope = (curve[n + 1] - curve[n]) / step
        rest = F.greatest(wanted - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(curve[n] * curve[n]) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.lit(n * step) + F.lit(2.0) * rest / (F.lit(curve[n]) + root)
        x = F.when(rest > 0, x).otherwise(F.lit(n * step))
        out = x if out is None else F.when(wanted >= F.lit(before), x).otherwise(out)
        before += area
    return F.least(out, F.lit(1.0))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, budget: Column | None = None
) -> DataFrame:
    """``__source``, ``__place`` (from 0 by code point, null last), ``source_size`` and ``target``.

    ``sizes`` has a row per source: ``__source`` and ``source_size``. Together sources get the
    sum of all sizes by weight; none gets more than ``repeats`` times its size, and what is
    above goes to the others by weight until all fit. Sorted by size over weight, the capped
    sources come first, so running sums over the sources find the level in one go.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sizes.withColumn("__place", F.row_number().over(by_name) - 1).withColumns(
        {
            "__weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int")).cast("bigint"),
            "__cap": F.lit(repeats).cast("bigint") * F.col("source_size"),
        }
    )
    filling = Window.orderBy((F.col("__cap") / F.col("__weight")).asc(), F.col("__place").asc())
    everything = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "__total": F.sum("source_size").over(everything),
            "__below": F.coalesce(F.sum("__cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__left": F.sum("__weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    fits = F.col("__cap") * F.col("__left") > (F.col("__total") - F.col("__below")) * F.col("__weight")
    ranked = ranked.withColumn("__free", fits)
    level = F.struct("__below", "__left")
    ranked = ranked.withColumn("__level", F.min(F.when(F.col("__free"), level)).over(everything))
    target = F.when(
        F.col("__free"),
        (F.col("__total") - F.col("__level.__below")).cast("double")
        * F.col("__weight").cast("double") / F.col("__level.__left").cast("double"),
    ).otherwise(F.col("__cap").cast("double"))
    return ranked.select("__source", "__place", "source_size", target.alias("target"))


def mix(
    sized: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    size_column: str = "size",
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
) -> DataFrame:
    """``sized`` with ``source_size``, ``target``, ``taken`` and ``positions``, in order of position.

    A source's tape orders its rows by MD5 of the id, then id and size. The target, rounded to
    whole words, is read off the tape from its start, as often as it goes round; the row where
    it ends is taken in part. ``taken`` counts words over all rounds, ``positions`` are the
    times of the rounds that take any, and rows never taken come last with none.

    A null source is a source of its own, a null id is hashed as the empty text; rows of size
    0 are never taken. Repeated rows lie side by side on the tape. Tapes are cut by the first
    hash digits, so no source has to fit a task; only sums of pieces are carried along.
    """
    columns = [c for c in sized.columns if c.lower() not in ("source_size", "target", "taken", "positions")]
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    tape = sized.select(*[F.col(f"`{c}`") for c in columns]).withColumns(
        {"__key": key, "__source": F.col(source_column), "__piece": F.substring(key, 1, 3)}
    )
    pieces = checkpointed(
        tape.groupBy("__source", "__piece").agg(F.sum(size_column).alias("__words")), "pieces"
    )
    sizes = pieces.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, weights, repeats)
    earlier = Window.partitionBy("__source").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(
        pieces.withColumn("__start", F.coalesce(F.sum("__words").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s")))
        .select(F.col("__source").alias("__s"), F.col("__piece").alias("__p"), "__start", "__place", "source_size", "target"),
        "starts",
    )
    rows = tape.join(
        starts, (F.col("__piece") == F.col("__p")) & F.col("__source").eqNullSafe(F.col("__s"))
    )
    inside = (
        Window.partitionBy("__piece", "__source")
        .orderBy("__key", id_column, size_column)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    size = F.col(size_column)
    rows = rows.withColumn("__at", F.col("__start") + F.sum(size_column).over(inside) - size)
    words = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumns({"__whole": whole, "__words": words})
    part = F.greatest(
        F.least(F.col("__words") - F.col("__whole") * F.col("source_size") - F.col("__at"), size), F.lit(0)
    )
    rows = rows.withColumn("__part", F.when(F.col("source_size") > 0, part).otherwise(F.lit(0)))
    rounds = F.col("__whole") + (F.col("__part") > 0).cast("bigint")
    time = F.lit(None).cast("double")
    share = F.col("__place") % len(schedules)

    def at(n: Column) -> Column:
        offset = (n * F.col("source_size") + F.col("__at")).cast("double") / F.col("__words").cast("double")
        out = time
        for i, curve in enumerate(schedules):
            out = F.when(share == i, inverse(offset, curve)).otherwise(out)
        return out

    positions = F.when(
        (size > 0) & (rounds > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), rounds - 1), at)
    ).otherwise(F.array().cast("array<double>"))
    return (
        rows.withColumns({"taken": F.col("__whole") * size + F.col("__part"), "positions": positions})
        .select(*[F.col(f"`{c}`") for c in columns], "source_size", "target", "taken", "positions")
        .orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), id_column)
    )


def schedule(mixed: DataFrame, size_column: str = "size") -> DataFrame:
    """One row per round of a document, in training order, with its ``position``.

    The row where a source's target ends counts for its last round if at least half of it
    was taken: documents are trained on whole.
    """
    size, taken = F.col(size_column), F.col("taken")
    rounds = F.when(size > 0, F.floor((taken * 2 + size) / (size * 2))).otherwise(0).cast("int")
    times = F.slice("positions", F.lit(1), F.greatest(rounds, F.lit(0)))
    return mixed.withColumn("position", F.explode(times)).orderBy("position")


_COUNT = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"


def _curve_sql() -> str:
    """The inverse of the schedules in SQL, with the arithmetic of :func:`inverse`."""
    cases = []
    for i, curve in enumerate(SCHEDULES):
        step = 1.0 / (len(curve) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(curve[:-1], curve[1:])]
        wanted, out, before = f"(share * {sum(areas)!r}::DOUBLE)", "", 0.0
        for n, area in enumerate(areas):
            slope = (curve[n + 1] - curve[n]) / step
            rest = f"greatest({wanted} - {before!r}::DOUBLE, 0.0::DOUBLE)"
            root = f"sqrt(greatest({curve[n] * curve[n]!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE))"
            x = (
                f"CASE WHEN {rest} > 0 THEN {n * step!r}::DOUBLE + 2.0::DOUBLE * {rest} / ({curve[n]!r}::DOUBLE + {root}) "
                f"ELSE {n * step!r}::DOUBLE END"
            )
            out = x if not out else f"CASE WHEN {wanted} >= {before!r}::DOUBLE THEN {x} ELSE {out} END"
            before += area
        cases.append(f"WHEN {i} THEN least({out}, 1.0::DOUBLE)")
    return f"CASE place % {len(SCHEDULES)} {' '.join(cases)} END"


ORACLE = rf"""
WITH tape AS (
  SELECT doc_id, source, {_COUNT} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM tape GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS weight, {REPEATS} * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM sizes
), filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), level AS (
  SELECT below, rest FROM filled WHERE cap * rest > (total - below) * weight
  ORDER BY below, rest LIMIT 1
), targets AS (
  SELECT source, place, source_size, CASE WHEN cap * f.rest > (total - f.below) * weight
    THEN (total - (SELECT below FROM level))::DOUBLE * weight::DOUBLE / (SELECT rest FROM level)::DOUBLE
    ELSE cap::DOUBLE END AS target
  FROM filled f
), placed AS (
  SELECT t.doc_id, t.size, g.place, g.source_size, g.target, round(g.target)::BIGINT AS words,
         (sum(t.size) OVER (PARTITION BY t.source ORDER BY t.key, t.doc_id, t.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t.size)::BIGINT AS spot
  FROM tape t JOIN targets g ON t.source IS NOT DISTINCT FROM g.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM placed
), ended AS (
  SELECT *, CASE WHEN source_size > 0 THEN greatest(least(words - whole * source_size - spot, size), 0) ELSE 0 END AS part,
         spot::DOUBLE / words::DOUBLE AS share
  FROM cut
)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       CASE WHEN size > 0 AND (whole > 0 OR part > 0) THEN round({_curve_sql()}, 9) END AS first_position
FROM ended
"""


@query("op8_curriculum", ORACLE)
def curriculum(spark, sf_dir):
    """Words taken from every document and the time training first meets it."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    return mix(sized).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position"),
    )
