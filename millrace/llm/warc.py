"""WARC archives as a PySpark data source.

Reading plans file partitions, tests pushed-down filters on the headers of a record, and
decodes a payload only if the record is wanted. Each record of a ``.warc.gz`` is a gzip
member of its own; members written here carry their length, so unwanted ones are skipped
without inflating more than their headers.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from dataclasses import dataclass

from millrace.llm.registry import query, table
from millrace.session import checkpointed, workspace

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_length bigint, refers_to string, payload binary"
)

#: Column and header it comes from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
    "refers_to": "warc-refers-to",
}
_MANIFEST = re.compile(r"_manifest(-[0-9a-f]+)?\.json")
#: Names of files written here; without being in a manifest they are not committed.
_OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One WARC record; without a payload it has HTTP headers only."""
    payload = row.get("payload")
    length = row.get("payload_length")
    if length is None:
        length = len(payload or b"")
    body = _HTTP % length + (payload or b"")
    head = [("WARC-Type", row["record_type"])]
    for name, header in (
        ("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"),
        ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To"),
    ):
        if row.get(name) is not None:
            head.append((header, _clean(str(row[name]))))
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", _PROFILE))
    head += [("X-Payload-Length", length), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


#: How every member written here begins: gzip header and the head of its only extra field.
_START = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the inflated length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    size = 24 + len(packed) + 8
    lengths = struct.pack("<II", size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return _START + lengths + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    """Name and record count of a finished file, None if a task had no rows."""

    file: str | None
    records: int


@dataclass
class Files(InputPartition):
    """Byte ranges ``(file, start, end)`` that one task reads; no end means the whole file."""

    files: list[tuple[str, int, int | None]]

    def __init__(self, files: list[tuple[str, int, int | None]]):
        super().__init__(files)
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Every attempt of a task writes a file of its own name; every write lists its committed ones.

    Appending adds a manifest. Overwriting removes the manifests and files of earlier writes,
    archives of others included, once its own manifest is there.
    """

    def __init__(self, path: str, level: int, overwrite: bool = False):
        self.path, self.level, self.overwrite = path, level, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        name, count, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member(record_bytes(row), self.level))
                    count += 1
        if out:
            out.close()
        return Written(name if out else None, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        earlier = [i.base_name for i in system.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.File]
        files = sorted(m.file for m in messages if m and m.file)
        own = f"_manifest-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{base}/{own}", compression=None) as out:
            out.write(json.dumps(files).encode())
        if self.overwrite:
            # Manifests first: a file without one is no longer read.
            gone = [n for n in earlier if n not in files and (_MANIFEST.fullmatch(n) or n.endswith((".warc", ".warc.gz")))]
            for name in sorted(gone, key=lambda n: not _MANIFEST.fullmatch(n)):
                system.delete_file(f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{base}/{m.file}")


def parse_head(head: bytes) -> dict[str, str]:
    """Header names in lower case and their values; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _content_length(head: dict[str, str]) -> int:
    value = head.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"Content-Length is {value!r}" if value else "no Content-Length")
    return int(value)


def _first_member(stream, start: int, end: int | None) -> int:
    """Where the first member written here begins at or after ``start``; ``end`` if none does before it."""
    at, kept = start, b""
    stream.seek(start)
    while end is None or at - len(kept) < end:
        data = stream.read(1 << 20)
        if not data:
            break
        found = (kept + data).find(_START)
        if found >= 0:
            return at - len(kept) + found
        at += len(data)
        kept = (kept + data)[-(len(_START) - 1) :]
    return end if end is not None else at


def _test(f: Filter, head: dict[str, str]) -> bool:
    value = head.get(HEADERS[f.attribute[0]])
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    return f.value in value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payload: bool):
        self.path, self.split_bytes, self.payload = path, split_bytes, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what headers alone can answer; give the rest back to Spark."""
        known = (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            named = isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if named and f.attribute[0] != "payload_length":
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in order, small ones together up to ``split_bytes``; large ones written here are split.

        Files of other names are read whole, by one task each: only members written here tell
        where they begin. Own files count if a manifest lists them.
        """
        system, base = _open(self.path)
        info = system.get_file_info(base)
        if info.type == pafs.FileType.File:
            return [Files([(base, 0, None)])]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = {i.base_name: i for i in system.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.File}
        committed = set()
        for name in filter(_MANIFEST.fullmatch, listed):
            with system.open_input_stream(f"{base}/{name}", compression=None) as file:
                committed.update(json.loads(file.read()))
        names = sorted(
            n for n in listed if n.endswith((".warc", ".warc.gz")) and (n in committed or not _OWN.fullmatch(n))
        )
        out, size = [Files([])], 0
        for name in names:
            length = listed[name].size
            splits = max(1, -(-length // self.split_bytes)) if _OWN.fullmatch(name) else 1
            edges = [length * n // splits for n in range(splits)] + [None if splits == 1 else length]
            for start, end in zip(edges[:-1], edges[1:]):
                if out[-1].files and size + length // splits > self.split_bytes:
                    out.append(Files([]))
                    size = 0
                out[-1].files.append((f"{base}/{name}", start, end))
                size += length // splits
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows, size = [], 0
        for name, start, end in partition.files:
            with system.open_input_file(name) as file:
                for row in self.records(file, name.endswith(".gz"), name, start, end):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def records(self, file, packed: bool, name: str = "", start: int = 0, end: int | None = None) -> Iterator[dict]:
        """Wanted records that begin in a byte range.

        A record that cannot be read (no or a wrong length, cut off, no gzip member) is an
        error that names the file and the byte at which it begins: nothing is left out.
        """
        stream = io.BufferedReader(_Raw(file), 1 << 20)
        if start:
            stream.seek(_first_member(stream, start, end))
        step = self._member if packed else self._plain
        while end is None or stream.tell() < end:
            at = stream.tell()
            try:
                row = step(stream)
            except (ValueError, EOFError, struct.error, zlib.error) as error:
                raise ValueError(f"{name}: record at byte {at}: {error}") from error
            if row is None:
                return
            if row:
                yield row

    def _wanted(self, head: dict[str, str]) -> bool:
        return all(_test(f, head) for f in self.filters)

    def _row(self, head: dict[str, str], body: bytes | None) -> dict:
        row = {column: head.get(header) for column, header in HEADERS.items()}
        if body is not None and (head.get("content-type") or "").startswith("application/http"):
            body = body.partition(b"\r\n\r\n")[2]
        if head.get("warc-type") == "revisit":
            body = None
        length = row["payload_length"]
        row["payload_length"] = int(length) if length is not None else None if body is None else len(body)
        row["payload"] = body
        return row

    def _plain(self, stream) -> dict | None:
        line = stream.readline()
        if not line:
            return None
        head = [line]
        while line not in (b"\r\n", b"\n", b""):
            line = stream.readline()
            head.append(line)
        fields = parse_head(b"".join(head))
        length = _content_length(fields)
        if self.payload and self._wanted(fields):
            body = stream.read(length)
            if len(body) < length:
                raise EOFError("the file ends within its content")
            row = self._row(fields, body)
        else:
            stream.seek(length, io.SEEK_CUR)
            row = self._row(fields, None) if self._wanted(fields) else {}
        while stream.peek(1)[:1] in (b"\r", b"\n"):
            stream.read(1)
        return row

    def _member(self, stream) -> dict | None:
        start = stream.tell()
        fixed = stream.read(12)
        if not fixed:
            return None
        if len(fixed) < 12:
            raise EOFError("the file ends within a gzip header")
        if fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        skip = None
        if fixed[3] & 4:
            extra = stream.read(struct.unpack("<H", fixed[10:12])[0])
            at = 0
            while at + 4 <= len(extra):
                size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if extra[at : at + 2] == b"sl" and size == 8:
                    skip = struct.unpack("<I", extra[at + 4 : at + 8])[0]
                at += 4 + size
        if fixed[3] & 4 and not fixed[3] & ~4 and skip:
            inflate, left = zlib.decompressobj(-15), skip - (stream.tell() - start) - 8
        else:
            # A foreign member: the gzip reader itself finds where it ends.
            stream.seek(start)
            inflate, left = zlib.decompressobj(31), None

        def more() -> bytes:
            nonlocal left
            data = stream.read(1 << 14 if left is None else min(left, 1 << 14))
            if left is not None:
                left -= len(data)
            return data

        data, pending = b"", b""
        while b"\r\n\r\n" not in data and not inflate.eof:
            pending = inflate.unconsumed_tail or more()
            if not pending:
                break
            data += inflate.decompress(pending, 4096)
        if b"\r\n\r\n" not in data:
            raise EOFError("the record ends within its headers")
        head, _, body = data.partition(b"\r\n\r\n")
        fields = parse_head(head)
        wanted = self._wanted(fields)
        length, parts = _content_length(fields), [body]
        if wanted and self.payload or left is None:
            while not inflate.eof:
                pending = inflate.unconsumed_tail or more()
                if not pending:
                    break
                part = inflate.decompress(pending, 1 << 20)
                if wanted and self.payload:
                    parts.append(part)
            if not inflate.eof:
                raise EOFError("the file ends within a gzip member")
        stream.seek(stream.tell() - len(inflate.unused_data) if left is None else start + skip)
        if not wanted:
            return {}
        return self._row(fields, b"".join(parts)[:length] if self.payload else None)


class _Raw(io.RawIOBase):
    """Arrow's random access files as Python raw files."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()


_ARROW = pa.schema(
    [(name, pa.int64() if name == "payload_length" else pa.string()) for name in HEADERS] + [("payload", pa.binary())]
)


class WarcSource(DataSource):
    """Format ``warc``. Options: ``split_bytes`` (32 MB), ``payload`` (``true``; ``false`` reads headers only), ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(
            self.options["path"], int(self.options.get("split_bytes", 32 << 20)),
            self.options.get("payload", "true").lower() == "true",
        )

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 6)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it push filters down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least: int = 1000, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Records of pages: payloads of at least ``least`` bytes appear once, others revisit them.

    The response of equal payloads is the page with the largest id (all pages that share it);
    null ids count only as revisits of another, or as responses where there is none. A null
    payload is empty. Only digests are grouped; the join on them may be skewed and AQE splits
    it, and revisits leave their payload behind.
    """
    payload = F.encode(F.coalesce(F.col(html_column), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    heads = checkpointed(
        rows.where(F.col("payload_length") >= least).groupBy("digest")
        .agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "head"),
        "heads",
    )
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    key = F.when(F.col("payload_length") >= least, F.col("digest")).otherwise(F.concat(F.lit("page "), F.col("id")))
    return rows.withColumn("of", key).join(heads, "of", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), "payload_length",
        F.when(revisit, urn("head")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


ORACLE = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), headed AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM headed
"""


@query("op5_warc", ORACLE)
def warc(spark, sf_dir):
    """Every page written to WARC archives and read back from them."""
    register(spark)
    path = workspace(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    decoded = F.col("record_type") == "response"
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        F.nullif(number("record_id"), F.lit("")).cast("bigint").alias("page_id"),
        F.when(decoded, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(decoded, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("bigint").alias("refers_to"),
    )
