"""Files cut into records by several tasks, and logs read as they grow."""

from __future__ import annotations

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.session import workspace
from millrace.sources import logtail
from millrace.sources.ranges import ArrayItems, QuotedLines, split_records
from millrace.sources.tables import read_table
from millrace.streaming.logs import tail_logs


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def cells(seed: int, rows: int = 200) -> list[list[str]]:
    pick = random.Random(seed)
    words = ['a', 'line\nbreak', 'say "so"', 'x,y', '"', 'ends\n', '5" pipe', '', ' ', '\n\n', 'ß' * 40, '"\n,"', "b" * 700]
    return [[str(n), pick.choice(words), pick.choice(words)] for n in range(rows)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_files_are_cut_among_tasks(spark, tmp_path, small_blocks, seed, ending):
    rows = cells(seed)
    for part in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["id", "one\nname", "two"])
        writer.writerows(rows[part::2])
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    records = split_records(spark, str(tmp_path), QuotedLines(","))
    assert records.rdd.getNumPartitions() > 20 and records.where("first").count() == 2
    table = read_table(spark, str(tmp_path), "csv")
    assert table.columns == ["id", "one\nname", "two"]
    found = {r[0]: (r[1], r[2]) for r in table.collect()}
    assert found == {int(a): (b or None, c or None) for a, b, c in rows}


def test_quotes_within_a_cell_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,size\n1,5" pipe\n2,6" pipe\n3,"two\nlines"\n')
    rows = read_table(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, '5" pipe'), (2, '6" pipe'), (3, "two\nlines")]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_are_cut_among_tasks(spark, tmp_path, small_blocks, indent):
    pick = random.Random(3)
    texts = ['}', '{', '"', '\\', '\\"}', '],[', 'plain', '', 'ü' * 50, "x" * 900, "a\nb"]
    rows = [
        {"id": n, "text": pick.choice(texts), "deep": {"list": [{"t": pick.choice(texts)}] * pick.randrange(3)}} for n in range(150)
    ]
    (tmp_path / "a.json").write_text(json.dumps(rows[:100], indent=indent))
    (tmp_path / "b.json").write_text("﻿ " + json.dumps(rows[100:], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "c.json").write_text(" [ ]\n")
    assert split_records(spark, str(tmp_path), ArrayItems()).rdd.getNumPartitions() > 20
    table = read_table(spark, str(tmp_path), "json")
    assert table.columns == ["id", "text", "deep"]
    found = {r.id: (r.text, [x.t for x in r.deep.list]) for r in table.collect()}
    assert found == {r["id"]: (r["text"], [x["t"] for x in r["deep"]["list"]]) for r in rows}


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}, 2, {"a": 3}]', '[{"a": 1}', '[[{"a": 1}]]', '[{"a": 1}] x'])
def test_other_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "a.json")).collect()


def run_tail(spark, folder: str, out: str, checkpoint: str, max_bytes: int):
    """One run of the stream until nothing is left; the number of its batches."""
    running = (
        tail_logs(spark, folder, max_bytes).writeStream.format("parquet")
        .option("checkpointLocation", checkpoint).option("path", out).start()
    )
    try:
        running.processAllAvailable()
        return [p.batchId for p in running.recentProgress if p.numInputRows]
    finally:
        running.stop()


def test_growing_logs_give_each_line_once(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "logs"), workspace(spark, "out"), workspace(spark, "cp")
    os.makedirs(f"{folder}/j1")
    lines = {"j1/job.log": [f"line {n} " + "é" * (n % 40) for n in range(60)], "top.log": ["", "x" * 900, "end"]}
    written = {name: "".join(f"{x}\n" for x in rows).encode() for name, rows in lines.items()}
    (tmp_path / "logs" / ".hidden").write_text("no\n")
    for share in (0.3, 0.31, 1.0):
        # Cut anywhere, within lines and characters too.
        for name, data in written.items():
            with open(f"{folder}/{name}", "ab") as file:
                file.write(data[file.tell() : int(len(data) * share)])
        batches = run_tail(spark, folder, out, checkpoint, 200)
        assert share != 1.0 or len(batches) > 3
    found = spark.read.schema("file string, start bigint, line string").parquet(out).orderBy("file", "start").collect()
    for name, rows in lines.items():
        mine = [r for r in found if r.file == name]
        assert [r.line for r in mine] == rows
        starts = [sum(len(x.encode()) + 1 for x in rows[:n]) for n in range(len(rows))]
        assert [r.start for r in mine] == starts
    assert len(found) == 63


def test_a_restarted_tail_keeps_its_bound(tmp_path):
    (tmp_path / "a.log").write_bytes(b"0123456789\n" * 10)
    reader = logtail.TailReader(str(tmp_path), 30)
    assert reader.latestOffset() == {"a.log": 30} == reader.latestOffset()
    assert [p.ranges for p in reader.partitions({}, {"a.log": 30})] == [[("a.log", 0, 30)]]
    again = logtail.TailReader(str(tmp_path), 30)
    assert again.partitions({"a.log": 60}, {"a.log": 60}) == []
    assert again.latestOffset() == {"a.log": 90}
    # A shorter file goes on from its new end; a file that is gone keeps its place.
    (tmp_path / "a.log").write_bytes(b"short\n")
    assert again.latestOffset() == {"a.log": 6}
    os.remove(tmp_path / "a.log")
    assert again.latestOffset() == {"a.log": 60}
    assert logtail.TailReader(str(tmp_path / "none"), 30).latestOffset() == {}


def test_broken_text_in_logs_is_replaced(tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok\r\n\xff\xfe!\nopen")
    reader = logtail.TailReader(str(tmp_path), 100)
    rows = [r for b in reader.read(logtail.Ranges([("a.log", 0, 13)])) for r in b.to_pylist()]
    assert [(r["start"], r["line"]) for r in rows] == [(0, "ok"), (4, "��!")]
