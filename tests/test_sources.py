from __future__ import annotations

import os

import pytest

from millrace.session import workspace
from millrace.sources import datasets, jsonlines, tables
from millrace.streaming.logs import poll_logs


def write(spark, name: str, text: str) -> str:
    folder = workspace(spark, "files")
    os.makedirs(folder)
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.mark.parametrize(
    "name, fmt",
    [("a.csv", "csv"), ("b.TXT", "csv"), ("noext", "csv"), ("x/y.z/noext", "csv"), ("t.tsv?x=.json", "tsv"),
     ("p.parquet#f", "parquet"), ("l.jsonl", "jsonl"), ("http://h/d.json?a/b.csv", "json"), (".csv", "csv")],
)
def test_format_of(name, fmt):
    assert tables.format_of(name) == fmt


def test_unknown_format():
    with pytest.raises(ValueError, match="Unsupported file type '.docx'. Use CSV"):
        tables.format_of("a.docx")


def test_csv_types_and_missing_values(spark):
    path = write(
        spark, "t.csv",
        'i,f,b,s,none,n,d\n1,1.5,True,x,NA,1,1d\n2,-2e3,false,"a ""b"", c",,NULL,2\n'
        '-3,inf,TRUE,n/a,nan,3,3\n',
    )
    df = tables.read_table(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "none": "double", "n": "bigint",
        "d": "string",
    }
    rows = df.orderBy("i").collect()
    assert [r.s for r in rows] == [None, "x", 'a "b", c']
    assert [r.n for r in rows] == [3, 1, None]
    assert rows[0].f == float("inf")


@pytest.mark.parametrize("multiline", [None, True])
def test_csv_line_breaks_in_cells(spark, multiline):
    path = write(spark, "t.csv", 'k,v\n1,"two\nlines"\n2,plain\n')
    df = tables.read_table(spark, path, multiline=multiline)
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "two\nlines"), (2, "plain")]


@pytest.mark.parametrize(
    "text", ['  [{"z": 1, "a": {"x": [1, 2]}},\n {"z": 2, "a": null}]', '{"z": 1, "a": {"x": [1, 2]}}\n{"z": 2, "a": null}\n']
)
def test_json_documents_and_lines(spark, text):
    df = tables.read_table(spark, write(spark, "t.json", text))
    flat = tables.coerce_nested(df).select("z", "a").orderBy("z").collect()
    assert [tuple(r) for r in flat] == [(1, '{"x":[1,2]}'), (2, None)]


def test_json_lines_keep_the_order_of_columns(spark):
    path = write(spark, "t.jsonl", '{"z": 1, "b": 2, "a": 3}\n\n{"z": 1, "c": 4}\n')
    assert tables.read_table(spark, path).columns == ["z", "b", "a", "c"]


def test_coerce_binary_and_nulls(spark):
    df = spark.createDataFrame([(b"ab", {"k": None})], "b binary, m map<string,int>")
    assert tuple(tables.coerce_nested(df).head()) == ("YWI=", '{"k":null}')


def test_names(spark):
    with pytest.raises(ValueError, match="A, a"):
        tables.normalize_names(spark.createDataFrame([(1, 2)], ["a", "A"]))


def test_empty_import_is_an_error(spark):
    with pytest.raises(ValueError, match="0 rows"):
        datasets.finalize(spark.range(5).where("id > 9"), workspace(spark, "empty"))


def test_failed_sources_do_not_stop_others(spark):
    good = write(spark, "good.csv", "a\n1\n")
    specs = [{"name": "bad", "path": "/no/such.csv"}, {"name": "good", "path": good}]
    rows = {r.name: r for r in datasets.import_many(spark, specs, workspace(spark, "many")).collect()}
    assert (rows["good"].status, rows["good"].num_rows, rows["good"].columns[0].name) == ("ready", 1, "a")
    assert rows["bad"].status == "failed" and 0 < len(rows["bad"].error) <= 2000


def test_ledger_lines(spark):
    path = write(
        spark, "l.jsonl",
        '{"seq":1,"kind":"action","id":"a","args":{"p": ["x", 1]},"undo":{"type":"fs","dir":"/d",'
        '"entries":[{"path":"/p","existed":true}]}}\n\n{"seq":2,"kind":"transition","id":"a","stat',
    )
    rows = jsonlines.read_ledger(spark, path).collect()
    assert [(r.seq, r.args, r.undo.entries[0].path) for r in rows] == [(1, '{"p": ["x", 1]}', "/p")]


def test_metric_points(spark):
    df = spark.createDataFrame([(1, 0.12345, "x", 2.0), (2, None, "y", 1.0)], "step int, epoch double, word string, loss double")
    rows = jsonlines.metric_points(df).orderBy("step").collect()
    assert [(r.step, r.epoch, r.loss) for r in rows] == [(1, 0.123, 2.0), (2, 0.0, 1.0)]
    assert "word" not in rows[0].asDict() and rows[0].time > 1e9


def test_poll_replaces_broken_text_and_clamps(spark):
    data = "aé".encode() * 4  # three bytes each
    chunks = spark.createDataFrame(
        [("j", 0, bytearray(data[:5])), ("j", 5, bytearray(data[5:]))], "job string, start bigint, data binary"
    )
    polls = [("j", -5), ("j", 2), ("j", 12), ("j", 99), ("none", 3)]
    df = poll_logs(chunks, spark.createDataFrame(polls, "job string, offset bigint"), 5)
    got = {(r.job, r.offset): (r.content, r.next_offset, r.size) for r in df.collect()}
    bad = "�"
    assert got == {
        ("j", -5): (f"aéa{bad}", 5, 12), ("j", 2): (f"{bad}aéa", 7, 12), ("j", 12): ("", 12, 12),
        ("j", 99): ("", 12, 12), ("none", 3): ("", 0, 0),
    }


def test_polls_read_on_through_a_large_chunk(spark):
    from millrace.streaming.logs import poll_logs

    data = bytes(97 + i % 26 for i in range(5000))
    chunks = spark.createDataFrame([("j", 0, bytearray(data[:4200])), ("j", 4200, bytearray(data[4200:]))], "job string, start bigint, data binary")
    offset, text = 0, ""
    for _ in range(5):
        (row,) = poll_logs(chunks, spark.createDataFrame([("j", offset)], "job string, offset bigint"), 1000).collect()
        text, offset = text + row.content, row.next_offset
    assert text.encode() == data and offset == 5000


def test_a_broken_json_line_is_an_error(spark, tmp_path):
    import pytest as pt

    from millrace.sources.tables import read_table

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pt.raises(Exception):
        read_table(spark, str(tmp_path / "a.jsonl")).collect()


def test_json_folder_of_arrays_and_lines(spark):
    path = write(spark, "a.json", '\n [{"k": 1, "v": 2}, {"k": 2, "v": 3}]')
    with open(f"{os.path.dirname(path)}/b [x].json", "w", encoding="utf-8") as f:
        f.write('{"k": 3, "v": "x"}\n{"k": 4, "w": true}\n')
    rows = tables.read_table(spark, os.path.dirname(path), "json").orderBy("k").collect()
    assert [(r.k, r.v, r.w) for r in rows] == [(1, "2", None), (2, "3", None), (3, "x", None), (4, None, True)]


def test_whole_numbers_beyond_64_bits_stay_apart(spark):
    path = write(spark, "t.csv", "a,b\n90000000000000000000001,1\n90000000000000000000002,9223372036854775808.5\n")
    df = tables.read_table(spark, path)
    assert dict(df.dtypes) == {"a": "string", "b": "double"}
    assert df.select("a").distinct().count() == 2


def test_empty_import_leaves_no_folder(spark):
    out = workspace(spark, "empty")
    with pytest.raises(datasets.EmptyImport):
        datasets.finalize(spark.createDataFrame([], "a int"), out)
    assert not os.path.exists(out)
