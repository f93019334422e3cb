"""Streams whose newest row per key is kept in a written table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import STATE_STORE

BATCH = "batch_id"


def use_disk_state(spark: SparkSession) -> None:
    """Keep stream state in RocksDB, so that it may outgrow executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def write_updates(
    changes: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], compact: int = 10, **trigger
):
    """Start a query that writes the changed rows of every micro-batch below ``folder``.

    A batch that runs again after a failure replaces its own rows. Before every ``compact``-th
    batch the newest rows of all earlier ones are merged into one folder, so their number stays
    bounded. Changes of batch n are numbered 2n + 1 and what is merged before it 2n: a merge
    appears at once by renaming, only then the folders it covers go, and any step may be cut off
    and done again. Read between batches: a read under way may miss files that a merge removed.
    """
    use_disk_state(changes.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact == 0:
            _merge(batch.sparkSession, folder, keys, 2 * batch_id)
        batch.write.mode("overwrite").parquet(f"{folder}/{BATCH}={2 * batch_id + 1}")

    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _merge(spark: SparkSession, folder: str, keys: Sequence[str], number: int) -> None:
    """Put the newest rows written before ``number`` below it, then remove what they came from."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    merged = path(f"{folder}/{BATCH}={number}")
    if not files.exists(merged):
        # Names that start with an underscore are not read as part of the table.
        current_rows(spark, folder, keys, number).write.mode("overwrite").parquet(f"{folder}/_merge")
        files.rename(path(f"{folder}/_merge"), merged)
    for status in files.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < number:
            files.delete(status.getPath(), True)


def current_rows(
    spark: SparkSession, folder: str, keys: Sequence[str], before: int | None = None
) -> DataFrame:
    """The newest written row of every key, of the folders numbered below ``before`` if given."""
    written = spark.read.parquet(folder)
    if before is not None:
        written = written.where(F.col(BATCH) < before)
    values = [c for c in written.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*values), BATCH).alias("row")
    return written.groupBy(*keys).agg(newest).select(*keys, "row.*")
