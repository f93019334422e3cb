"""Feature preparation fitted on training rows only, and seeded held-out splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import HASH_RANGE, hash32
from millrace.operators.profile import as_value, column_stats, is_nested, is_numeric, quoted

# A categorical column has at most 200 values; rarer than 2 rows is infrequent.
MAX_CATEGORIES = 200
MIN_FREQUENCY = 2
MAX_STRATA = 10_000

TEST = "is_test"


class NoFeatures(ValueError):
    """No column can serve as a feature."""


# ---------------------------------------------------------------- feature roles


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]
    dropped: list[str]


def feature_roles(df: DataFrame, label: str) -> Roles:
    """Numeric columns, columns with up to 200 values, and the rest, which is left out."""
    rest = df.drop(label)
    numeric = [f.name for f in rest.schema.fields if is_numeric(f.dataType)]
    other = [f.name for f in rest.schema.fields if f.name not in numeric]
    texts = [n for n in other if not isinstance(rest.schema[n].dataType, T.BinaryType)]
    few: list[str] = []
    if texts:
        stats = column_stats(rest.select(*[quoted(n) for n in texts]))
        few = [c.name for c in stats.columns if c.n_unique is not None
               and c.n_unique <= MAX_CATEGORIES]
    if not numeric and not few:
        raise NoFeatures("no column is left to learn from")
    return Roles(numeric, few, [n for n in other if n not in few])


# ---------------------------------------------------------------- exact medians


@dataclass
class _Search:
    """Search for the value of one rank among the non-null values of one column."""

    column: str
    rank: int
    inside: int  # values strictly between low and high
    below: int = 0  # values up to and including low
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def within(self) -> Column:
        cell = number(self.column)
        test = cell.isNotNull()
        if self.low is not None:
            test = test & (cell > self.low)
        if self.high is not None:
            test = test & (cell < self.high)
        return test

    def values(self) -> Column:
        return F.when(self.within(), number(self.column))


def number(name: str) -> Column:
    """Cell as a double, NaN as null."""
    cell = quoted(name).cast("double")
    return F.when(~F.isnan(cell), cell)


def medians(
    df: DataFrame,
    columns: Sequence[str],
    limit: int = 100_000,
    counts: dict[str, int] | None = None,
) -> dict[str, float]:
    """Exact medians (mean of the two middle values), also of columns too large to sort.

    Each round estimates two values around the wanted rank and counts exactly how many
    values lie below, on, between and above them, so the range shrinks about a
    thousandfold. The last values, at most ``limit`` over all open ranges of a round (but 64 of
    each), are sorted. No task and no driver ever holds a column. ``counts`` gives the values
    per column if they are known already.
    """
    if counts is None:
        row = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).head()
        counts = dict(zip(columns, row, strict=True))
    searches = []
    for column in columns:
        n = counts[column]
        if n:
            searches += [_Search(column, r, n) for r in sorted({(n - 1) // 2, n // 2})]
    open_ = list(searches)
    while open_:
        _narrow(df, open_, limit)
        open_ = [s for s in open_ if s.found is None]
    middles: dict[str, list[float]] = {}
    for s in searches:
        middles.setdefault(s.column, []).append(s.found)
    return {c: sum(v) / len(v) for c, v in middles.items()}


def _narrow(df: DataFrame, searches: list[_Search], limit: int) -> None:
    """One round: find the values of short ranges, cut the others down."""
    ranges: dict[tuple, list[_Search]] = {}
    for s in searches:
        ranges.setdefault((s.column, s.low, s.high), []).append(s)
    groups = list(ranges.values())
    # All ranges are gathered in one row, so they share the limit.
    limit = max(limit // len(groups), min(limit, 64))
    margin = 0.0005
    picks = []
    for i, group in enumerate(groups):
        one, places = group[0], [s.rank - s.below for s in group]
        if one.inside <= limit:
            values = F.sort_array(F.collect_list(one.values()))
            pick = F.slice(values, min(places) + 1, max(places) - min(places) + 1)
        else:
            around = [
                max((min(places) + 0.5) / one.inside - margin, 0.0),
                min((max(places) + 0.5) / one.inside + margin, 1.0),
            ]
            pick = F.percentile_approx(one.values(), around, 10_000)
        picks.append(pick.alias(f"p{i}"))
    picked = df.agg(*picks).head()

    tallies = []
    for i, group in enumerate(groups):
        one, values = group[0], picked[f"p{i}"]
        if one.inside <= limit:
            first = min(s.rank for s in group)
            for s in group:
                s.found = values[s.rank - first]
            continue
        low, high = values
        cell = one.values()
        tallies += [
            F.count_if(cell < low).alias(f"a{i}"),
            F.count_if(cell == low).alias(f"b{i}"),
            F.count_if((cell > low) & (cell < high)).alias(f"c{i}"),
            F.count_if(cell == high).alias(f"d{i}"),
        ]
    if not tallies:
        return
    tally = df.agg(*tallies).head()
    for i, group in enumerate(groups):
        if group[0].found is None:
            counted = [tally[f"{x}{i}"] for x in "abcd"]
            for s in group:
                _enter_part(s, *picked[f"p{i}"], *counted)


def _enter_part(s: _Search, low, high, a: int, b: int, c: int, d: int) -> None:
    """Go on in the part that holds the rank: below, on, between, on or above two values."""
    if low == high:
        d = 0
    at = s.rank - s.below
    if at < a:
        s.high, s.inside = low, a
    elif at < a + b:
        s.found = low
    elif at < a + b + c:
        s.low, s.high, s.below, s.inside = low, high, s.below + a + b, c
    elif at < a + b + c + d:
        s.found = high
    else:
        s.low, s.below, s.inside = high, s.below + a + b + c + d, s.inside - a - b - c - d


# ---------------------------------------------------------------- fitted preparation


def literal(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


@dataclass(frozen=True)
class NumericFeature:
    """Median imputation, then scaling with the population deviation."""

    column: str
    median: float
    mean: float
    deviation: float

    def imputed_sql(self) -> str:
        cell = f"CAST({_name(self.column)} AS DOUBLE)"
        return f"nvl(nanvl({cell}, CAST({self.median!r} AS DOUBLE)), CAST({self.median!r} AS DOUBLE))"

    def scaled_sql(self) -> str:
        return (
            f"({self.imputed_sql()} - CAST({self.mean!r} AS DOUBLE))"
            f" / CAST({self.deviation!r} AS DOUBLE)"
        )


@dataclass(frozen=True)
class CategoryFeature:
    """Most-frequent imputation, then one slot per frequent value and one for rare ones."""

    column: str
    dtype: str
    mode: str
    frequent: list[str]
    infrequent: list[str] = field(default_factory=list)

    def labels(self) -> list[str]:
        """Slot names; the sign keeps them from being empty or equal to the rare one."""
        named = [f"={v}" for v in self.frequent]
        return [*named, "rare"] if self.infrequent else named

    def imputed_sql(self) -> str:
        return f"nvl(CAST({_name(self.column)} AS STRING), {literal(self.mode)})"

    def label_sql(self) -> str:
        value = self.imputed_sql()
        named = f"concat('=', {value})"
        if not self.infrequent:
            return named
        rare = ", ".join(literal(v) for v in self.infrequent)
        return f"CASE WHEN {value} IN ({rare}) THEN 'rare' ELSE {named} END"

    def slot(self) -> Column:
        """One-hot slot of a row, from 0; null for a value unseen in training."""
        places = F.lit(self.labels())
        at = F.array_position(places, F.expr(self.label_sql()))
        return F.when(at > 0, at - 1)


@dataclass(frozen=True)
class Preparation:
    numeric: list[NumericFeature]
    categorical: list[CategoryFeature]


def fit_numeric(train: DataFrame, columns: Sequence[str]) -> list[NumericFeature]:
    """Medians, and mean and deviation of the imputed values, of numeric columns."""
    if not columns:
        return []
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggregates += [
            F.count(number(c)).alias(f"n{i}"),
            F.avg(number(c)).alias(f"avg{i}"),
            F.var_pop(number(c)).alias(f"var{i}"),
        ]
    s = train.agg(*aggregates).head()
    middle = medians(train, columns, counts={c: s[f"n{i}"] for i, c in enumerate(columns)})
    out = []
    for i, c in enumerate(columns):
        n, missing = s[f"n{i}"], s.rows - s[f"n{i}"]
        if not n:
            continue  # nothing to impute from
        avg, var, median = s[f"avg{i}"], s[f"var{i}"], middle[c]
        mean = (n * avg + missing * median) / s.rows
        spread = n * (var + (avg - mean) ** 2) + missing * (median - mean) ** 2
        deviation = (spread / s.rows) ** 0.5
        out.append(NumericFeature(c, median, mean, deviation or 1.0))
    return out


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of several columns: ``(i, value, rows)`` with null values kept."""
    cells = [
        F.struct(F.lit(i).alias("i"), as_value(df.schema[c]).alias("value"))
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("i", "value").agg(F.count("*").alias("rows"))


def fit_categorical(train: DataFrame, columns: Sequence[str]) -> list[CategoryFeature]:
    """Mode and vocabulary of categorical columns, which hold at most 200 values each.

    More values raise an error; no more than that many rows ever reach the driver.
    """
    if not columns:
        return []
    tallies: dict[int, dict[str | None, int]] = {}
    # One more row than all columns may have together, null cells counted as a value.
    most = len(columns) * (MAX_CATEGORIES + 1) + 1
    for r in value_counts(train, columns).limit(most).collect():
        tallies.setdefault(r["i"], {})[r["value"]] = r["rows"]
    for i, tally in tallies.items():
        if len(tally) - (None in tally) > MAX_CATEGORIES:
            raise ValueError(f"'{columns[i]}' has more than {MAX_CATEGORIES} values to encode")
    out = []
    for i, column in enumerate(columns):
        tally = tallies.get(i, {})
        missing = tally.pop(None, 0)
        if not tally:
            continue
        mode = min(tally, key=lambda v: (-tally[v], v))
        tally[mode] += missing
        frequent = sorted(v for v, n in tally.items() if n >= MIN_FREQUENCY)
        rare = sorted(v for v, n in tally.items() if n < MIN_FREQUENCY)
        dtype = train.schema[column].dataType.simpleString()
        out.append(CategoryFeature(column, dtype, mode, frequent, rare))
    return out


def fit_preparation(train: DataFrame, roles: Roles) -> Preparation:
    """Fit all feature preparation on the training rows."""
    return Preparation(
        fit_numeric(train, roles.numeric), fit_categorical(train, roles.categorical)
    )


def impute_median(df: DataFrame, fitted: Sequence[NumericFeature]) -> DataFrame:
    return df.withColumns({f.column: F.expr(f.imputed_sql()) for f in fitted})


def scale(df: DataFrame, fitted: Sequence[NumericFeature]) -> DataFrame:
    return df.withColumns({f.column: F.expr(f.scaled_sql()) for f in fitted})


def impute_mode(df: DataFrame, fitted: Sequence[CategoryFeature]) -> DataFrame:
    return df.withColumns({f.column: F.expr(f.imputed_sql()).cast(f.dtype) for f in fitted})


# ---------------------------------------------------------------- splits


def row_key(df: DataFrame) -> Column:
    """A key made from the whole row; equal rows share it and fall on the same side."""
    flat = [quoted(f.name) for f in df.schema.fields if not is_nested(f.dataType)]
    nested = [F.to_json(quoted(f.name)) for f in df.schema.fields if is_nested(f.dataType)
              and not isinstance(f.dataType, T.VariantType)]
    cells = [F.coalesce(c.cast("string"), F.lit("\0")) for c in [*flat, *nested]]
    return F.md5(F.concat_ws("\x1f", *cells))


def split(
    df: DataFrame,
    fraction: float,
    seed: int,
    key: str | Column,
    strata: str | None = None,
    exact: bool = False,
    sizes: dict[str, int] | None = None,
) -> DataFrame:
    """Add ``is_test``: about ``fraction`` of the rows, chosen by a seeded hash of the key.

    The default needs no shuffle, and takes the same share of every stratum in
    expectation. ``exact`` takes ``ceil(fraction * rows)`` rows, in proportion from each
    stratum if one is named, or a few more where the last key taken has several rows.
    ``sizes`` are the rows per stratum if :func:`class_sizes` counted them already.
    """
    key = F.col(key) if isinstance(key, str) else key
    if not exact:
        return df.withColumn(TEST, hash32(seed, key) < int(fraction * HASH_RANGE))
    if sizes is None:
        sizes = class_sizes(df, strata) if strata else {"": df.count()}
    return _exact_split(df, fraction, seed, key, strata, sizes)


def held_out_sizes(totals: dict, fraction: float) -> dict:
    """Held-out rows per stratum: ``ceil(fraction * rows)`` overall, shared in proportion."""
    rows = sum(totals.values())
    wanted = math.ceil(round(rows * fraction, 6))
    sizes = {s: n * wanted // rows for s, n in totals.items()}
    # Largest fractional parts first; equal ones in order of the stratum.
    left = sorted(totals, key=lambda s: (-(totals[s] * wanted % rows), s is not None, s or ""))
    for s in left[: wanted - sum(sizes.values())]:
        sizes[s] += 1
    return sizes


def _exact_split(df: DataFrame, fraction, seed, key: Column, strata, sizes: dict) -> DataFrame:
    """The wanted number of smallest hashes per stratum.

    Ranking all rows of a stratum would need one task per stratum. Instead hashes are
    counted in buckets, the bucket holding the last wanted row is found from the counts, and
    only that bucket is ranked. There are about as many buckets as rows in each, but 65,536
    at least, so both steps grow with the square root of the rows.
    """
    total = sum(sizes.values())
    if not total:
        return df.withColumn(TEST, F.lit(False))
    stratum = quoted(strata).cast("string") if strata else F.lit("")
    rows = df.withColumns(
        {"__s": stratum, "__h": hash32(seed, key), "__k": key.cast("string")}
    )
    held_out = list(held_out_sizes(sizes, fraction).items())
    wanted = df.sparkSession.createDataFrame(held_out, "__e string, wanted bigint")
    same = F.col("__s").eqNullSafe(F.col("__e"))
    bucket = F.shiftright("__h", 32 - max(16, min(math.ceil(math.log2(total) / 2), 32)))
    upto = Window.partitionBy("__s").orderBy("bucket")
    edge = (
        rows.groupBy("__s", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .join(F.broadcast(wanted), same)
        .where("wanted > upto - n AND wanted <= upto")
        .select("__e", "bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("take"))
    )
    # Rows with equal keys fall on one side, so they are counted before they are ranked.
    ranked = Window.partitionBy("__e").orderBy("__h", "__k")
    last = (
        rows.join(F.broadcast(edge), same & (bucket == F.col("bucket")))
        .groupBy("__e", "take", "__h", "__k")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(ranked))
        .where("take > upto - n AND take <= upto")
        .select("__e", F.struct("__h", "__k").alias("__last"))
    )
    chosen = F.coalesce(F.struct("__h", "__k") <= F.col("__last"), F.lit(False))
    # At most one row per stratum on the broadcast sides.
    return (
        rows.join(F.broadcast(last), same, "left")
        .withColumn(TEST, chosen)
        .drop("__s", "__h", "__k", "__e", "__last")
    )


def class_sizes(df: DataFrame, label: str) -> dict[str | None, int]:
    """Rows per class, of at most 10,000 classes."""
    counts = df.groupBy(quoted(label).cast("string").alias("c")).agg(F.count("*").alias("n"))
    sizes = {r.c: r.n for r in counts.limit(MAX_STRATA + 1).collect()}
    if len(sizes) > MAX_STRATA:
        raise ValueError(f"'{label}' has more than {MAX_STRATA} classes to hold rows out of")
    return sizes
