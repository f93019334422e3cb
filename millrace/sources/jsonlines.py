"""Metric points and audit events kept as folders of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = (
    "time double, job bigint, seq bigint, step bigint, epoch double, loss double, "
    "eval_loss double, eval_accuracy double, metrics map<string,double>"
)
UNDO_SCHEMA = "struct<type:string,dir:string,entries:array<struct<path:string,existed:boolean>>>"
LEDGER_SCHEMA = (
    "seq bigint, kind string, id string, ts string, server string, tool string, args string, "
    f"tier string, status string, note string, undo {UNDO_SCHEMA}"
)


def _json_lines(spark: SparkSession, folder: str, schema, stream: bool, max_files: int | None):
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A line cut off in the middle of a write is dropped, and read when its file is complete.
    return reader.option("mode", "DROPMALFORMED").json(folder)


def read_metrics(
    spark: SparkSession, folder: str, stream: bool = False, schema=METRIC_SCHEMA, max_files=None
) -> DataFrame:
    """Metric points of a folder, skipping blank and torn lines."""
    return _json_lines(spark, folder, schema, stream, max_files)


def read_ledger(
    spark: SparkSession, folder: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Audit events of a folder; ``args`` stays JSON text."""
    return _json_lines(spark, folder, LEDGER_SCHEMA, stream, max_files)


def metric_points(points: DataFrame) -> DataFrame:
    """Points as they are stored: numeric entries only, epoch to 3 places, a ``time`` stamp."""
    kept = [
        f.name
        for f in points.schema.fields
        if isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.MapType)
    ]
    out = points.select(*kept)
    if "epoch" in kept:
        out = out.withColumn("epoch", F.round(F.coalesce("epoch", F.lit(0)), 3))
    if "time" not in kept:
        now = F.unix_micros(F.current_timestamp()) / 1e6
        out = out.select(now.alias("time"), "*")
    return out


def append_jsonl(df: DataFrame, folder: str) -> None:
    """Add the rows of ``df`` to a folder of JSON lines."""
    df.write.mode("append").json(folder)


def append_stream(df: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start a query that adds the rows of a stream to a folder of JSON lines."""
    writer = df.writeStream.format("json").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start(folder)
