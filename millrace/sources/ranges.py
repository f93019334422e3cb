"""Records of files that line breaks alone do not separate, read by several tasks per file.

Spark cuts a file into blocks and blocks into pieces at a separator. Whether a piece ends a
record depends on all that precedes it in the file: on being inside a quoted text, and on
nesting depth. Every block first tells what it makes of either beginning; chained along a
file, that gives the state each block begins in. Then all blocks are cut at once, and only
the records that cross a border between blocks are put together from their fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORD, _HEAD, _TAIL, _MIDDLE = 0, 1, 2, 3


class QuotedLines:
    """Lines of delimited text; a quote opens a cell only at its beginning, and two stand for one."""

    separator, ending = "\n", ""
    _rest = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')

    def __init__(self, sep: str):
        self.sep = sep

    def run(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the piece ends inside a text, and by how much depth changed."""
        at = 0
        if not inside:
            at = 0 if piece[:1] == '"' else self._next(piece, 0)
            if at < 0:
                return False, 0
            at += 1
        while True:
            closed = self._rest.match(piece, at)
            if not closed:
                return True, 0
            at = self._next(piece, closed.end())
            if at < 0:
                return False, 0
            at += 1

    def _next(self, piece: str, at: int) -> int:
        """Place of the next quote that opens a cell."""
        found = piece.find(self.sep + '"', at)
        return found if found < 0 else found + 1

    def closed(self, inside: bool, depth: int) -> bool:
        return not inside

    def finished(self, inside: bool, depth: int) -> bool:
        """Whether a file may end so."""
        return True


class ArrayItems:
    """Objects of one top-level JSON array; pieces end before a closing brace."""

    separator, ending = "}", "}"
    _rest = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)

    def run(self, piece: str, inside: bool) -> tuple[bool, int]:
        at, depth = 0, 0
        while True:
            if inside:
                closed = self._rest.match(piece, at)
                if not closed:
                    return True, depth
                at, inside = closed.end(), False
            quote = piece.find('"', at)
            plain = piece[at:] if quote < 0 else piece[at:quote]
            depth += plain.count("{") + plain.count("[") - plain.count("]")
            if quote < 0:
                return False, depth - 1
            at, inside = quote + 1, True

    def closed(self, inside: bool, depth: int) -> bool:
        return not inside and depth == 1

    def finished(self, inside: bool, depth: int) -> bool:
        # The last piece holds the closing bracket and counts as if a brace followed.
        return not inside and depth == -1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """File, block and next pieces, in the order of the file."""
    for batch in batches:
        files, starts, pieces = (batch.column(n).to_pylist() for n in ("file", "block", "piece"))
        at = 0
        while at < len(pieces):
            end = at
            while end < len(pieces) and (files[end], starts[end]) == (files[at], starts[at]):
                end += 1
            yield files[at], starts[at], pieces[at:end]
            at = end


def _survey(machine):
    """Of every block: the state it ends in and the change of depth, for both beginnings."""

    def done(block, both) -> pa.RecordBatch:
        values = [*block, both[0][0], both[0][1], both[1][0], both[1][1]]
        names = ["file", "block", "inside0", "depth0", "inside1", "depth1"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both = None, None
        for file, block, pieces in _blocks(batches):
            if (file, block) != now:
                if now:
                    yield done(now, both)
                now, both = (file, block), [(False, 0), (True, 0)]
            for piece in pieces:
                first = machine.run(piece, both[0][0])
                second = first if both[0][0] == both[1][0] else machine.run(piece, both[1][0])
                both = [(first[0], both[0][1] + first[1]), (second[0], both[1][1] + second[1])]
        if now:
            yield done(now, both)

    return run


def _cut(machine, starts):
    """Records of every block, and the fragments of those that cross its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, [], []
        inside, depth, kind, first = False, 0, _RECORD, False

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            names = ["file", "block", "kind", "first", "text"]
            out_batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return out_batch

        def rest() -> None:
            if open_:
                out.append((*now, _MIDDLE if kind == _HEAD else _TAIL, first, machine.separator.join(open_)))
                open_.clear()

        for file, block, pieces in _blocks(batches):
            if (file, block) != now:
                rest()
                now = (file, block)
                inside, depth = starts.value[now]
                first = block == 0
                kind = _RECORD if first or machine.closed(inside, depth) else _HEAD
            for piece in pieces:
                open_.append(piece)
                inside, change = machine.run(piece, inside)
                depth += change
                if machine.closed(inside, depth):
                    out.append((*now, kind, first, machine.separator.join(open_) + machine.ending))
                    open_.clear()
                    kind, first = _RECORD, False
            if len(out) >= 1000:
                yield batch()
        rest()
        if out:
            yield batch()

    return run


def split_records(spark: SparkSession, paths: str | list[str], machine) -> DataFrame:
    """``file``, ``first`` (of its file) and ``text`` of every record.

    What follows the last complete record of a file comes as one more record. The driver
    sees one small row per block of a file.
    """
    pieces = spark.read.option("lineSep", machine.separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece")
    )
    survey = "file string, block bigint, inside0 boolean, depth0 bigint, inside1 boolean, depth1 bigint"
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    ends: dict[str, tuple[bool, int]] = {}
    for row in sorted(pieces.mapInArrow(_survey(machine), survey).collect(), key=lambda r: (r.file, r.block)):
        state = starts[row.file, row.block] = ends.get(row.file, (False, 0))
        inside, change = (row.inside1, row.depth1) if state[0] else (row.inside0, row.depth0)
        ends[row.file] = inside, state[1] + change
    for file, state in ends.items():
        if not machine.finished(*state):
            raise ValueError(f"{file}: the file ends within a record")
    known = spark.sparkContext.broadcast(starts)
    found = pieces.mapInArrow(_cut(machine, known), "file string, block bigint, kind int, first boolean, text string")
    whole = found.where(F.col("kind") == _RECORD).select("file", "first", "text")
    # A tail opens a record, middles and one head follow it: a few rows per block.
    place = F.when(F.col("kind") == _TAIL, 1).otherwise(0)
    along = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where(F.col("kind") != _RECORD).withColumn("place", place)
    parts = parts.withColumn("nth", F.sum("place").over(along))
    crossing = parts.groupBy("file", "nth").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("parts")
    )
    text = F.array_join(F.col("parts.text"), machine.separator)
    return whole.unionByName(crossing.select("file", "first", text.alias("text")))
