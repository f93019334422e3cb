"""Imports: write a normalised Parquet copy of a source and record what it holds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.profile import PROFILE_SCHEMA, column_stats, profile_rows
from millrace.session import remove, side_by_side
from millrace.sources.tables import coerce_nested, import_table, normalize_names

MAX_ERROR_CHARS = 2000

DATASET_SCHEMA = (
    "name string, source_ref string, path string, format string, num_rows bigint, "
    f"size_bytes bigint, columns array<struct<{PROFILE_SCHEMA}>>, "
    "status string, error string"
)


class EmptyImport(ValueError):
    """The source gave no rows."""


def finalize(df: DataFrame, out: str, name: str = "", source_ref: str = "", order_by=None):
    """Write ``df`` to the folder ``out`` and return its dataset row as a DataFrame."""
    spark = df.sparkSession
    row = _written(df, out, name, source_ref, order_by)
    return spark.createDataFrame([row], DATASET_SCHEMA)


def _written(df: DataFrame, out: str, name: str, source_ref: str, order_by) -> tuple:
    spark = df.sparkSession
    table = coerce_nested(normalize_names(df))
    # Written first and counted from the copy: an emptiness test beforehand would read
    # the source twice.
    table.write.parquet(out)
    stored = spark.read.schema(table.schema).parquet(out)
    stats = column_stats(stored)
    if stats.rows == 0:
        remove(spark, out)
        raise EmptyImport("the source gave 0 rows")
    size = list_files(spark, out, "*.parquet").agg(F.sum("length")).head()[0]
    profile = profile_rows(stored, stats, order_by)
    return (name, source_ref, out, "parquet", stats.rows, size, profile, "ready", None)


def import_many(spark: SparkSession, specs: Iterable[Mapping], out_root: str) -> DataFrame:
    """Import several sources; one that fails is reported and does not stop the others.

    A spec holds ``name`` and ``path`` and optionally ``fmt``, ``max_rows``, ``order_by``.
    """

    def row(numbered: tuple[int, Mapping]) -> tuple:
        i, spec = numbered
        out = f"{out_root}/{i}"
        name, path = spec["name"], spec["path"]
        try:
            table = import_table(
                spark, path, spec.get("max_rows"), spec.get("order_by"), spec.get("fmt")
            )
            return _written(table, out, name, path, spec.get("order_by"))
        except Exception as error:
            message = str(error)[:MAX_ERROR_CHARS]
            return (name, path, out, "parquet", None, None, None, "failed", message)

    return spark.createDataFrame(side_by_side(spark, row, enumerate(specs)), DATASET_SCHEMA)


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder with their sizes, sorted by relative path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = folder.rstrip("/")
    return (
        reader.load(folder)
        .select(F.substring_index("path", f"{root}/", -1).alias("file"), "length")
        .orderBy("file")
    )
