"""Training metrics and job logs as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.metrics import latest_metrics
from millrace.sources.logtail import MAX_POLL_BYTES, stream_lines
from millrace.streaming.tables import write_updates


def stream_latest(entries: DataFrame, folder: str, checkpoint: str, **trigger):
    """Keep the newest value of every metric of a stream of entries; see ``current_rows``."""
    return write_updates(latest_metrics(entries), folder, checkpoint, ["job", "key"], **trigger)


def tail_logs(spark: SparkSession, folder: str, max_bytes: int = MAX_POLL_BYTES) -> DataFrame:
    """Stream the lines added to log files, at most ``max_bytes`` of a file per batch.

    See :func:`millrace.sources.logtail.stream_lines`; files may grow between batches.
    """
    return stream_lines(spark, folder, max_bytes)


def poll_logs(
    chunks: DataFrame, polls: DataFrame, max_bytes: int = MAX_POLL_BYTES
) -> DataFrame:
    """Next piece of a log from a byte offset: ``(job, offset, content, next_offset, size)``.

    ``chunks`` has ``job, start, data``: consecutive byte ranges of any length.
    Offsets outside the log are moved to its ends. A poll joins only the few chunk ranges it
    can touch, so neither a long log nor a busy one gathers in one task.
    """
    end = F.col("start") + F.octet_length("data")
    sizes = chunks.groupBy("job").agg(F.max(end).alias("size"))
    asked = polls.select("job", "offset").distinct().join(sizes, "job", "left")
    size = F.coalesce(F.col("size"), F.lit(0))
    asked = asked.select(
        "job", "offset", size.cast("bigint").alias("size"),
        F.greatest(F.lit(0), F.least("offset", size)).cast("bigint").alias("at"),
    )
    span = F.lit(max_bytes).cast("bigint")
    block = F.floor(F.col("at") / span)
    touched = asked.withColumn("block", F.explode(F.array(block, block + 1)))
    # A chunk lies in every block it covers, however large it is.
    last = F.greatest(F.floor((end - 1) / span), F.floor(F.col("start") / span))
    placed = chunks.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / span), last)))
    skip = F.greatest(F.col("at") - F.col("start"), F.lit(0)).cast("int")
    take = F.least(F.col("at") + span, end) - F.greatest("at", "start")
    pieces = touched.join(placed, ["job", "block"]).where(
        (F.col("start") < F.col("at") + span) & (end > F.col("at"))
    ).select(
        "job", "offset",
        F.struct("start", F.substring("data", skip + 1, take.cast("int")).alias("data")).alias("p"),
    )
    joined = F.aggregate(
        F.sort_array(F.collect_set("p")),
        F.lit(b""),
        lambda text, piece: F.concat(text, piece["data"]),
    )
    read = pieces.groupBy("job", "offset").agg(joined.alias("bytes"))
    found = F.coalesce(F.col("bytes"), F.lit(b""))
    return asked.join(read, ["job", "offset"], "left").select(
        "job",
        "offset",
        F.make_valid_utf8(found.cast("string")).alias("content"),
        (F.col("at") + F.octet_length(found)).alias("next_offset"),
        "size",
    )
