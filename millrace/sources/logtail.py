"""Growing log files as a stream, by byte offset: a Python data source.

A batch covers a byte range of every file, and its end offsets are all the state there is.
A line belongs to the range that holds its line break, so it comes exactly once, however
ranges cut it, and an unfinished line waits for its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "log_tail"
MAX_POLL_BYTES = 200_000
_BLOCK = 1 << 16
_SCHEMA = "file string, start bigint, line string"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("line", pa.string())])


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, of this machine where it names no scheme."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Ranges(InputPartition):
    """Byte ranges ``(file, start, end)`` that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


class LogTail(DataSource):
    """Options: ``path`` and ``max_bytes`` of a file in one batch."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("max_bytes", MAX_POLL_BYTES)))


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int):
        if max_bytes < 1:
            raise ValueError("max_bytes must be positive")
        self.path, self.max_bytes = path, max_bytes
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What each file has now, but no more than ``max_bytes`` beyond the last batch.

        A file that became shorter goes on from its new end; one that is gone keeps its place.
        """
        system, base = open_folder(self.path)
        found = dict(self.seen)
        if system.get_file_info(base).type == pafs.FileType.NotFound:
            return found
        for info in system.get_file_info(pafs.FileSelector(base, recursive=True)):
            name = info.path[len(base) :].strip("/")
            if info.type != pafs.FileType.File or any(part[0] in "._" for part in name.split("/")):
                continue
            start = min(self.seen.get(name, 0), info.size)
            found[name] = min(info.size, start + self.max_bytes)
        return found

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """One task per 16 full files or per so many bytes; a restart tells its place by an empty range."""
        self.seen = dict(end)
        out, size = [Ranges([])], 0
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            if stop <= begin:
                continue
            if size + stop - begin > 16 * self.max_bytes and out[-1].ranges:
                out.append(Ranges([]))
                size = 0
            out[-1].ranges.append((name, begin, stop))
            size += stop - begin
        return [p for p in out if p.ranges]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(self.path)
        for name, start, end in partition.ranges:
            with system.open_input_file(f"{base}/{name}") as file:
                rows = [(name, at, line.decode("utf-8", "replace")) for at, line in ended_lines(file, start, end)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def ended_lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines whose line break lies in ``[start, end)``.

    The beginning of the first one is looked up backwards, block by block.
    """
    file.seek(start)
    data = file.read(end - start)
    last = data.rfind(b"\n")
    if last < 0:
        return
    head = []
    while start > 0:
        block = min(start, _BLOCK)
        file.seek(start - block)
        before = file.read(block)
        cut = before.rfind(b"\n") + 1
        head.append(before[cut:])
        start -= len(before) - cut
        if cut:
            break
    data = b"".join(reversed(head)) + data[: last + 1]
    at = start
    for line in data[:-1].split(b"\n"):
        yield at, line.removesuffix(b"\r")
        at += len(line) + 1


def stream_lines(spark: SparkSession, folder: str, max_bytes: int = MAX_POLL_BYTES) -> DataFrame:
    """``file``, ``start`` (byte offset) and ``line`` of log files as they grow.

    Files are found in all subfolders, but for names that begin with ``.`` or ``_``. Broken
    UTF-8 is replaced. The offsets of a batch, one per file, lie in the query's checkpoint.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format(FORMAT).option("path", folder).option("max_bytes", max_bytes).load()


def append_lines(lines: DataFrame, folder: str, file: str, order: str, text: str) -> int:
    """Add ``text`` to the end of the file each row names, in ``order``; returns the lines added.

    For file systems that can append. The rows of a file are written by one task, as a log has
    one writer; a task that is run again would repeat its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        now, out, count = None, None, 0
        for batch in batches:
            for name, line in zip(batch.column(file).to_pylist(), batch.column(text).to_pylist()):
                if name != now:
                    if out:
                        out.close()
                    path = f"{base}/{name}"
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    if system.get_file_info(path).type == pafs.FileType.NotFound:
                        out = system.open_output_stream(path, compression=None)
                    else:
                        out = system.open_append_stream(path, compression=None)
                    now = name
                out.write(((line or "") + "\n").encode())
                count += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    dealt = lines.select(file, order, text).repartition(file).sortWithinPartitions(file, order)
    return sum(r.n for r in dealt.mapInArrow(run, "n bigint").collect())
