"""Column profiles and the guesses made from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of a stored profile, preferred column names in order of preference.
SAMPLE_VALUES = 5
SAMPLE_CHARS = 120
MAX_UNIQUE = 1000
MIN_CLASSES, MAX_CLASSES = 2, 100
TEXT_SAMPLE = 200
PREVIEW_ROWS, MAX_PREVIEW_ROWS = 50, 500
TEXT_NAMES = (
    "text", "sentence", "content", "review", "prompt", "question", "instruction", "document",
    "comment",
)
LABEL_NAMES = (
    "label", "labels", "target", "class", "category", "sentiment", "score", "rating", "y",
)

PROFILE_SCHEMA = (
    "name:string,dtype:string,n_unique:bigint,unique_capped:boolean,samples:array<string>"
)

#: Estimated distinct count from which a column is first tried on a part of its values.
_TRY_PART_ABOVE = 4 * MAX_UNIQUE
#: Rows of the first look that bounds the smallest values.
_LOOK_ROWS = 1000


@dataclass(frozen=True)
class ColumnStat:
    name: str
    dtype: T.DataType
    n_unique: int | None  # capped at MAX_UNIQUE; None for nested columns
    mean_length: float | None  # text columns only


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: tuple[ColumnStat, ...]

    def column(self, name: str) -> ColumnStat:
        return next(c for c in self.columns if c.name == name)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans; dates and times are not numeric."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_value(field: T.StructField) -> Column:
    """Cell as text, one text per distinct value; NaN counts as missing."""
    cell = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        # Adding zero joins -0.0 and 0.0.
        cell = F.when(~F.isnan(cell), cell + F.lit(0.0))
    elif isinstance(field.dataType, T.BinaryType):
        cell = F.hex(cell)
    return cell.cast("string")


def _text_lengths(df: DataFrame, order_by, sample: int) -> dict[str, float | None]:
    """Mean length over the first ``sample`` non-null values of each text column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = _first_cells(df, [F.length(quoted(n)) for n in names], order_by, sample)
    return {n: sum(cells) / len(cells) if cells else None for n, cells in zip(names, found, strict=True)}


def column_stats(df: DataFrame, order_by=None, sample: int = TEXT_SAMPLE) -> TableStats:
    """Row count, distinct counts capped at 1000 and mean text lengths of all columns.

    Exact, with little shuffled, and the same way for tables of any size. All columns are
    estimated in one scan and counted in a second one, after partial aggregation; where the
    estimate is high a hash-chosen share of the *values* takes part, which proves the cap
    once 1000 of them are seen. Should a share fall short, its column is counted in full.
    """
    flat = [f for f in df.schema.fields if not is_nested(f.dataType)]
    texts = [f.name for f in flat if isinstance(f.dataType, T.StringType)]
    rows, estimates, lengths = _estimate(df, flat, texts)
    counts = _count_unproven(df, estimates)
    if order_by is not None:
        lengths = _text_lengths(df, order_by, sample)
    columns = []
    for field in df.schema.fields:
        n = counts.get(field.name)
        capped = None if n is None else min(n, MAX_UNIQUE)
        columns.append(ColumnStat(field.name, field.dataType, capped, lengths.get(field.name)))
    return TableStats(rows, tuple(columns))


def _estimate(df: DataFrame, unproven: list, texts: list[str]) -> tuple[int, dict, dict]:
    """Rows, estimated distinct counts and mean lengths of the whole table, in one scan."""
    wanted = [F.count(F.lit(1)).alias("rows")]
    wanted += [F.avg(F.length(quoted(n))).alias(f"m{i}") for i, n in enumerate(texts)]
    # A sixteenth of the rows is enough to tell few values from many. Estimating too low only
    # means that more values are counted.
    wanted += [
        F.approx_count_distinct(F.when(F.col("__some"), quoted(f.name))).alias(f"u{i}")
        for i, f in enumerate(unproven)
    ]
    seen = df.withColumn("__some", F.rand(7) < 1 / 16).agg(*wanted).head()
    estimates = {f.name: seen[f"u{i}"] for i, f in enumerate(unproven)}
    return seen.rows, estimates, {n: seen[f"m{i}"] for i, n in enumerate(texts)}


def _count_unproven(df: DataFrame, estimates: dict[str, int]) -> dict[str, int]:
    shares = {
        n: 1 if estimate <= _TRY_PART_ABOVE else estimate // (2 * MAX_UNIQUE)
        for n, estimate in estimates.items()
    }
    counts = _distinct_counts(df, shares)
    short = {n: 1 for n, m in shares.items() if m > 1 and counts.get(n, 0) < MAX_UNIQUE}
    counts.update(_distinct_counts(df, short))
    return {n: counts.get(n, 0) for n in shares}


def _distinct_counts(df: DataFrame, shares: dict[str, int]) -> dict[str, int]:
    """Distinct values per column, of those whose hash falls into one of ``m`` parts."""
    if not shares:
        return {}
    names = list(shares)
    cells = []
    for i, name in enumerate(names):
        field = df.schema[name]
        number = F.lit(None).cast("bigint")
        real = F.lit(None).cast("double")
        text = F.lit(None).cast("string")
        # Numbers are grouped as they are, which is cheaper than as text.
        if isinstance(field.dataType, T.IntegralType):
            number = _of_part(quoted(name).cast("bigint"), name, shares[name])
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            known = F.when(~F.isnan(quoted(name)), quoted(name).cast("double"))
            real = _of_part(known, name, shares[name])
        else:
            text = _of_part(as_value(field), name, shares[name])
        cells.append(
            F.struct(F.lit(i).alias("i"), number.alias("n"), real.alias("r"), text.alias("t"))
        )
    values = df.select(F.inline(F.array(*cells))).where(
        "n IS NOT NULL OR r IS NOT NULL OR t IS NOT NULL"
    )
    counted = values.distinct().groupBy("i").count()
    return {names[r["i"]]: r["count"] for r in counted.collect()}


def _of_part(value: Column, name: str, share: int) -> Column:
    """The value where the hash of its cell falls into the chosen part, else null."""
    if share == 1:
        return value
    return F.when(F.pmod(F.xxhash64(quoted(name)), F.lit(share)) == 0, value)


def _text_cell(field: T.StructField) -> Column:
    if is_nested(field.dataType):
        return F.to_json(quoted(field.name), {"ignoreNullFields": "false"})
    return as_value(field)


def sample_values(df: DataFrame, order_by=None, n: int = SAMPLE_VALUES) -> dict[str, list[str]]:
    """First ``n`` non-null values of every column as text, cut to 120 characters.

    Without ``order_by`` the smallest ones. The number of jobs does not depend on the number
    of columns.
    """
    cells = [_text_cell(f) for f in df.schema.fields]
    if order_by:
        cells = [F.substring(c, 1, SAMPLE_CHARS) for c in cells]
        return dict(zip(df.columns, _first_cells(df, cells, order_by, n), strict=True))
    found = _smallest_cells(df, cells, n)
    return dict(zip(df.columns, [[v[:SAMPLE_CHARS] for v in values] for values in found], strict=True))


def _first_cells(df: DataFrame, cells: list[Column], order_by, n: int) -> list[list]:
    """The first ``n`` non-null values of every cell in the order of some columns.

    The first ``4 n`` rows settle most columns. Those with fewer values in them are ranked
    together in one pass.
    """
    if not cells:
        return []
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    rows = _first_rows(df, cells, keys, 4 * n)
    found = [[r[i] for r in rows if r[i] is not None][:n] for i in range(len(cells))]
    # Shorter lists are final only if these were all the rows.
    short = [i for i, values in enumerate(found) if len(values) < n] if len(rows) == 4 * n else []
    if short:
        ranked = _ranked(df, {i: cells[i] for i in short}, [quoted(k) for k in keys], n)
        for i in short:
            found[i] = ranked.get(i, [])
    return found


def _first_rows(df: DataFrame, cells: list[Column], keys: list[str], n: int) -> list:
    """Cells of the first ``n`` rows.

    Their order keys are looked up alone; the range they span then skips most of the files.
    """
    first, *others = [quoted(k) for k in keys]
    low = [r[0] for r in df.select(first).where(first.isNotNull()).orderBy(first).limit(n).collect()]
    rows = df.where(first <= F.lit(low[-1])) if len(low) == n else df
    named = [c.alias(f"v{i}") for i, c in enumerate(cells)]
    order = [F.col(f"k{i}").asc_nulls_last() for i in range(len(keys))]
    placed = rows.select(*named, *[k.alias(f"k{i}") for i, k in enumerate([first, *others])])
    return placed.orderBy(*order).limit(n).select(*[f"v{i}" for i in range(len(cells))]).collect()


def _smallest_cells(df: DataFrame, cells: list[Column], n: int) -> list[list[str]]:
    """The ``n`` smallest texts of every cell, repeated ones included.

    ``n`` values of any rows bound them from above, so a first look at some rows keeps nearly
    all others out of the ranking.
    """
    look = _ranked(df.limit(_LOOK_ROWS), dict(enumerate(cells)), [], n)
    bounded = {}
    for i, cell in enumerate(cells):
        seen = look.get(i, [])
        near = F.substring(cell, 1, SAMPLE_CHARS) <= F.lit(seen[-1][:SAMPLE_CHARS]) if len(seen) == n else F.lit(True)
        bounded[i] = F.when(near, cell)
    found = _ranked(df, bounded, [], n)
    return [found.get(i, []) for i in range(len(cells))]


def _ranked(df: DataFrame, cells: dict[int, Column], keys: list[Column], n: int) -> dict[int, list]:
    """The first ``n`` non-null values of all cells in one job, by ``keys`` or by themselves.

    Every task keeps ``n`` values of a cell before anything is shuffled.
    """
    order = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    values = [F.struct(F.lit(i).alias("i"), *order, cell.alias("value")) for i, cell in cells.items()]
    along = [f"k{i}" for i in range(len(keys))] or ["value"]
    by = Window.partitionBy("i").orderBy(*[F.col(c).asc_nulls_last() for c in along])
    ranked = (
        df.select(F.inline(F.array(*values))).where("value IS NOT NULL")
        .withColumn("r", F.row_number().over(by)).where(F.col("r") <= n)
    )
    found: dict[int, list] = {}
    for row in sorted(ranked.select("i", "r", "value").collect(), key=lambda r: (r.i, r.r)):
        found.setdefault(row.i, []).append(row.value)
    return found


def samples(df: DataFrame, order_by=None, n: int = SAMPLE_VALUES) -> DataFrame:
    """The values of :func:`sample_values` as ``(name, position, sample)``."""
    found = sample_values(df, order_by, n)
    rows = [(name, i, v) for name, values in found.items() for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "name string, position int, sample string")


def profile_rows(df: DataFrame, stats: TableStats, order_by=None) -> list[tuple]:
    shown = sample_values(df, order_by)
    return [
        (
            c.name,
            c.dtype.simpleString(),
            c.n_unique,
            bool(c.n_unique and c.n_unique >= MAX_UNIQUE),
            shown.get(c.name, []),
        )
        for c in stats.columns
    ]


def profile(df: DataFrame, order_by=None) -> DataFrame:
    """One row per column: name, type, capped distinct count, whether capped, samples."""
    rows = profile_rows(df, column_stats(df), order_by)
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def _preferred(names: list[str], wanted: tuple[str, ...]) -> str | None:
    by_lower = {n.lower(): n for n in names}
    return next((by_lower[w] for w in wanted if w in by_lower), None)


def text_column(stats: TableStats) -> str | None:
    """Most likely free-text column: a usual name, else the longest texts on average."""
    named = _preferred([c.name for c in stats.columns], TEXT_NAMES)
    if named:
        return named
    best, longest = None, 0.0
    for c in stats.columns:
        if (c.mean_length or 0) > longest:
            best, longest = c.name, c.mean_length
    return best


def label_column(stats: TableStats) -> str | None:
    """Most likely target: a usual name, else the fewest distinct values from 2 to 100."""
    named = _preferred([c.name for c in stats.columns], LABEL_NAMES)
    if named:
        return named
    text = text_column(stats)
    fitting = [
        c
        for c in stats.columns
        if c.name != text and c.n_unique and MIN_CLASSES <= c.n_unique <= MAX_CLASSES
    ]
    return min(fitting, key=lambda c: c.n_unique).name if fitting else None


def guess_text_column(df: DataFrame, order_by=None, sample: int = TEXT_SAMPLE) -> str | None:
    """See :func:`text_column`. With ``order_by`` only the first ``sample`` values count."""
    named = _preferred(df.columns, TEXT_NAMES)
    if named:
        return named
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    if order_by is not None:
        lengths = _text_lengths(df, order_by, sample)
    else:
        row = df.agg(*[F.avg(F.length(quoted(n))).alias(f"m{i}") for i, n in enumerate(texts)])
        lengths = dict(zip(texts, row.head(), strict=True))
    return text_column(
        TableStats(0, tuple(ColumnStat(n, T.StringType(), None, lengths[n]) for n in texts))
    )


def guess_label_column(df: DataFrame) -> str | None:
    """See :func:`label_column`; a usual name needs no look at the data."""
    return _preferred(df.columns, LABEL_NAMES) or label_column(column_stats(df))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by=None) -> DataFrame:
    """First rows as JSON records."""
    n = max(1, min(n, MAX_PREVIEW_ROWS))
    head = (df.orderBy(order_by) if order_by else df).limit(n)
    return head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def suggest(df: DataFrame, n: int = PREVIEW_ROWS, order_by=None) -> DataFrame:
    """Preview records next to the guessed text and label column."""
    stats = column_stats(df)
    return preview(df, n, order_by).select(
        "record",
        F.lit(text_column(stats)).cast("string").alias("text_column"),
        F.lit(label_column(stats)).cast("string").alias("label_column"),
    )
