"""The audit ledger as streams: replay, commands, repeated holds and expiry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ledger import (
    EXPIRED,
    dedupe_holds,
    first_commands,
    replay,
    with_fingerprint,
)
from millrace.operators.policy import UNDO_WINDOW_MS
from millrace.session import remove
from millrace.streaming.tables import use_disk_state, write_updates

HOLD_SCHEMA = "seq bigint, id string, fp string"


def stream_replay(events: DataFrame, folder: str, checkpoint: str, **trigger):
    """Keep the current state of every action of an event stream; see ``current_rows``."""
    return write_updates(replay(events), folder, checkpoint, ["id"], **trigger)


def stream_commands(
    commands: DataFrame, folder: str, checkpoint: str, agents_may_commit: bool = False, **trigger
):
    """Keep the deciding commands of every action; join them with ``after_commands``.

    The checkpoint sees to it that each command line counts once.
    """
    firsts = first_commands(commands, agents_may_commit)
    return write_updates(firsts, folder, checkpoint, ["id"], **trigger)


def stream_holds(events: DataFrame, folder: str, checkpoint: str, **trigger):
    """Mark repeated holds of a stream of calls and releases.

    ``events`` has ``kind`` (``call`` or ``release``) and the call columns; batches arrive in
    ``seq`` order. Each batch runs the batch operator on its events and the holds still open,
    which are written below ``folder/open``; results go below ``folder/calls``. Open holds are
    kept for two batches, intermediates until their batch is written.
    """
    spark = events.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        calls = with_fingerprint(batch.where("kind = 'call'")).select("seq", "id", "fp")
        releases = batch.where("kind = 'release'").select("seq", "id")
        open_before = _open_holds(spark, folder, batch_id)
        work = f"{folder}/work/{batch_id}"
        remove(spark, work)  # of an attempt that was cut off
        marked = dedupe_holds(calls.unionByName(open_before), releases, folder=work)
        old = open_before.select("id")
        fresh = marked.join(old, "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/calls/batch_id={batch_id}")
        still = marked.where("NOT repeat").join(releases.select("id"), "id", "left_anti")
        still.select("seq", "id", "fp").write.mode("overwrite").parquet(f"{folder}/open/{batch_id}")
        remove(spark, work)
        # This batch may run again and needs the one before it, but none earlier.
        remove(spark, f"{folder}/open/{batch_id - 2}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _open_holds(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], HOLD_SCHEMA)
    return spark.read.schema(HOLD_SCHEMA).parquet(f"{folder}/open/{batch_id - 1}")


def stream_expiry(
    events: DataFrame, window_ms: int = UNDO_WINDOW_MS, lateness: str = "0 seconds"
) -> DataFrame:
    """``final`` transitions of a ledger stream, by event time.

    ``events`` has ``kind, id, status`` and a timestamp ``event_time``. An applied action is
    final if nothing happened to it within the window and the watermark has passed its end.
    An outer join of the stream with itself, whose state is dropped with the watermark.
    """
    use_disk_state(events.sparkSession)
    seen = events.select("kind", "id", "status", "event_time").withWatermark("event_time", lateness)

    # Tests that read the event time stay above the watermark, so that it follows all events.
    def only(test) -> DataFrame:
        return seen.where(F.when(F.col("event_time").isNotNull(), test))

    applied = only((F.col("kind") == "action") & (F.col("status") == "applied"))
    changes = only(F.col("kind") == "transition").select(
        F.col("id").alias("changed"), F.col("event_time").alias("changed_at")
    )
    end = F.col("event_time") + F.lit(timedelta(milliseconds=window_ms))
    within = F.col("changed_at").between(F.col("event_time"), end)
    ended = applied.join(changes, (F.col("id") == F.col("changed")) & within, "left_outer")
    return ended.where("changed IS NULL").select(
        F.lit("transition").alias("kind"),
        "id",
        F.lit("final").alias("status"),
        F.lit(EXPIRED).alias("note"),
    )
