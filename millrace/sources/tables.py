"""Readers for CSV, TSV, JSON, JSONL and Parquet that give one normalised table."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import ACCEPTED, FORMATS
from millrace.session import workspace
from millrace.sources.ranges import ArrayItems, QuotedLines, split_records

# Cell texts that mean "missing" in delimited files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf(inity)?)\s*$"
BOOLEAN_TEXT = r"^(True|TRUE|true|False|FALSE|false)$"

DEFAULT_MAX_ROWS = 5000


class UnsupportedFormat(ValueError):
    """The file suffix names no reader."""


def format_of(name: str) -> str:
    """Reader for a file name or URL, chosen by its suffix."""
    for mark in "?#":
        name = name.split(mark, 1)[0]
    base = name.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, ending = base.rpartition(".")
    suffix = f".{ending.lower()}" if dot and stem and ending else ""
    if suffix not in FORMATS:
        raise UnsupportedFormat(f"Unsupported file type '{suffix}'. Use {ACCEPTED}.")
    return FORMATS[suffix]


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, multiline: bool | None = None
) -> DataFrame:
    """Read a file or a folder of files; ``fmt`` overrides the suffix of ``path``.

    ``multiline`` tells whether quoted CSV cells hold line breaks; by default one cheap scan
    looks for an unbalanced quote. Such files and arrays of JSON objects are cut into records
    by several tasks per file, see ``ranges``.
    """
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return _read_json_lines(spark, path)
    if fmt == "json":
        return _read_json(spark, path)
    if fmt in ("csv", "tsv"):
        return _read_delimited(spark, path, "\t" if fmt == "tsv" else ",", multiline)
    raise UnsupportedFormat(f"Unsupported format '{fmt}'. Use {ACCEPTED}.")


def _read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    table = spark.read.option("mode", "FAILFAST").json(path)
    # Inference sorts the columns by name; the first record restores their written order.
    first = (
        spark.read.text(path)
        .where(F.col("value").rlike(r"\S"))
        .select(F.json_object_keys("value").alias("names"))
        .head()
    )
    written = [n for n in (first.names or [] if first else []) if n in table.columns]
    return table.select(
        *[F.col(f"`{n}`") for n in [*written, *[c for c in table.columns if c not in written]]]
    )


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """Every file is an array of records or has one record per line; a folder may hold both."""
    # Records end at "{" so that a document on one huge line is not read whole.
    records = spark.read.option("lineSep", "{").text(path)
    opening = F.regexp_extract("value", r"^[\uFEFF\s]*(\S)", 1) == "["
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    kinds = (
        records.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), opening.alias("array"))
        .groupBy("file").agg(F.min_by("array", "at").alias("array"))
    )
    files = [(_literal(r.file), r.array) for r in kinds.collect()]
    arrays = [f for f, array in files if array]
    lines = [f for f, array in files if not array]
    if not arrays:
        return _read_json_lines(spark, path)
    items = _array_items(spark, arrays)
    return _stack(items, _read_json_lines(spark, lines)) if lines else items


def _array_items(spark: SparkSession, files: list[str]) -> DataFrame:
    """The objects of top-level arrays, cut by several tasks and read as lines."""
    records = split_records(spark, files, ArrayItems())
    # Raw line breaks are mere space in JSON; what follows the last object closes the array.
    text = F.translate("text", "\r\n", "  ")
    opening = F.when(F.col("first"), F.lit(r"^[\uFEFF\s]*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    item = F.when(F.col("first") & text.rlike(r"^[\uFEFF\s]*\[\s*\]\s*$"), F.lit("")).otherwise(
        F.when(text.rlike(r"^\s*\]?\s*$") & ~F.col("first"), F.lit("")).otherwise(F.regexp_replace(text, opening, F.lit("")))
    )
    checked = F.when(
        (item == "") | item.startswith("{"), item
    ).otherwise(F.raise_error(F.concat(F.lit("not an array of objects: "), F.substring("text", 1, 80))))
    folder = workspace(spark, "array-items")
    records.select(checked.alias("value")).where("value != ''").write.text(folder)
    return _read_json_lines(spark, folder)


def _literal(uri: str) -> str:
    """A file's address as a path that the reader takes as it is."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _stack(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns whose types have no common number type become text."""
    for name in [n for n in a.columns if n in b.columns]:
        kinds = [df.schema[name].dataType for df in (a, b)]
        if kinds[0] != kinds[1] and not all(isinstance(k, T.NumericType) for k in kinds):
            a, b = (_as_text(df, name) for df in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def _as_text(df: DataFrame, name: str) -> DataFrame:
    cell = F.col(f"`{name}`")
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return df.withColumn(name, F.to_json(cell) if nested else cell.cast("string"))


def _read_delimited(
    spark: SparkSession, path: str, sep: str, multiline: bool | None
) -> DataFrame:
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    options = {"header": "true", "sep": sep, "escape": '"', "multiLine": str(multiline).lower()}
    raw = spark.read.options(**options).csv(path)
    return infer_types(_quoted_records(spark, path, raw.schema, options) if multiline else raw)


def _quoted_records(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """Rows of files whose cells hold line breaks; several tasks read one file."""
    records = split_records(spark, path, QuotedLines(options["sep"])).where(~F.col("first"))
    text = F.regexp_replace("text", r"\r$", "")
    # A header that holds a line break of its own may hide how lines end.
    schema = T.StructType([T.StructField(f.name.removesuffix("\r"), f.dataType) for f in schema.fields])
    cells = F.from_csv(text, schema.toDDL(), options)
    return records.where(text.rlike(r"[^\r\n]")).select(cells.alias("cells")).select("cells.*")


def infer_types(raw: DataFrame) -> DataFrame:
    """Type text columns: missing words become null, then the narrowest type that fits all.

    A column of whole numbers with any beyond 64 bits stays text, as a double would merge ids.
    """
    cells = {n: _present(n) for n in raw.columns}
    checks = []
    for i, cell in enumerate(cells.values()):
        checks += [
            F.count(cell).alias(f"n{i}"),
            # The pattern first: a cast that fails costs far more than a test.
            F.count(F.when(cell.rlike(WHOLE_TEXT), cell.try_cast("bigint"))).alias(f"bigint{i}"),
            F.count_if(cell.rlike(WHOLE_TEXT)).alias(f"whole{i}"),
            F.count_if(cell.rlike(f"(?i){DECIMAL_TEXT}")).alias(f"double{i}"),
            F.count_if(cell.rlike(BOOLEAN_TEXT)).alias(f"boolean{i}"),
        ]
    counts = raw.agg(*checks).head()
    typed = []
    for i, (name, cell) in enumerate(cells.items()):
        n = counts[f"n{i}"]
        fits = (t for t in ("bigint", "double", "boolean") if counts[f"{t}{i}"] == n)
        # A column without any value is numeric, as an all-missing column of floats.
        target = "double" if n == 0 else next(fits, "string")
        if target == "double" and n > 0 and counts[f"whole{i}"] == n:
            target = "string"
        typed.append(cell.try_cast(target).alias(name))
    return raw.select(*typed)


def _present(name: str):
    cell = F.col(f"`{name}`")
    return F.when(~cell.isin(list(MISSING)), cell)


def import_table(
    spark: SparkSession,
    path: str,
    max_rows: int | None = None,
    order_by: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Read a source and keep its first ``max_rows`` rows, all of them by default.

    With ``order_by`` "first" is defined by that column; without it Spark stops reading
    as soon as it has enough rows.
    """
    table = read_table(spark, path, fmt)
    if max_rows is None:
        return table
    return (table.orderBy(order_by) if order_by else table).limit(max_rows)


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names as text, refusing names that differ only in case."""
    names = [str(n) for n in df.columns]
    folded = [n.lower() for n in names]
    doubles = sorted({n for n in names if folded.count(n.lower()) > 1})
    if doubles:
        raise ValueError(f"Column names are not unique: {', '.join(doubles)}")
    return df.toDF(*names)


def coerce_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and binary ones as Base64 text; null stays null."""
    out = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BinaryType):
            cell = F.base64(cell)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            cell = F.to_json(cell, {"ignoreNullFields": "false"})
        out.append(cell.alias(field.name))
    return df.select(*out)
