"""Streams keep a bounded number of folders, and merged tables say the same."""

from __future__ import annotations

import os

from conftest import SMALL
from pyspark.sql import functions as F

from millrace.plans import audit as plans_audit
from millrace.session import workspace
from millrace.streaming import audit, tables


def folders(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))


def batches(spark, rows, schema, n):
    """A stream of ``n`` files, in the order of their numbers."""
    folder = workspace(spark, "stream-in")
    for part in range(n):
        spark.createDataFrame(rows[part::n], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_merged_updates(spark):
    rows = [(n % 4, n) for n in range(28)]
    out, checkpoint = workspace(spark, "merged"), workspace(spark, "merged-cp")
    stream = batches(spark, rows, "id bigint, n bigint", 7).groupBy("id").agg(F.max("n").alias("n"))
    tables.write_updates(stream, out, checkpoint, ["id"], compact=3).awaitTermination()
    # Seven batches: merged before batch 6, which then wrote its own.
    assert folders(out) == ["batch_id=12", "batch_id=13"]
    got = {r.id: r.n for r in tables.current_rows(spark, out, ["id"]).collect()}
    assert got == {0: 24, 1: 25, 2: 26, 3: 27}
    # A merge that was cut off after its renaming is finished when it is done again.
    spark.createDataFrame([(0, -1)], "id bigint, n bigint").write.parquet(f"{out}/batch_id=5")
    tables._merge(spark, out, ["id"], 12)
    assert folders(out) == ["batch_id=12", "batch_id=13"]
    assert {r.id: r.n for r in tables.current_rows(spark, out, ["id"]).collect()} == got


def test_holds_remove_their_intermediates(spark):
    schema = "kind string, seq bigint, id string, server string, tool string, args string"
    rows = [("call", n, f"h{n}", "s", "t", "{}") for n in range(4)]
    out = workspace(spark, "holds")
    stream = batches(spark, rows, schema, 4)
    audit.stream_holds(stream, out, workspace(spark, "holds-cp")).awaitTermination()
    found = spark.read.parquet(f"{out}/calls").collect()
    assert len(found) == 4 and len({r.held_as for r in found}) == 1
    assert folders(f"{out}/work") == [] and folders(f"{out}/open") == ["2", "3"]


def test_holds_are_staged_by_many_tasks(spark, monkeypatch):
    folders = []

    def noted(session, label):
        folders.append(workspace(session, label))
        return folders[-1]

    monkeypatch.setattr(plans_audit, "workspace", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = plans_audit.holds_stream(spark, SMALL)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Three batches, each of several files.
    assert len([n for n in os.listdir(folders[0]) if n.endswith(".parquet")]) > 3
    assert folders_of_batches(folders[1]) == 3 and found.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def folders_of_batches(path: str) -> int:
    return len(folders(f"{path}/calls"))
