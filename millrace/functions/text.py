"""Column expressions on text, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted file suffixes and the reader each one selects.
FORMATS = {
    ".csv": "csv",
    ".txt": "csv",
    "": "csv",
    ".tsv": "tsv",
    ".parquet": "parquet",
    ".jsonl": "jsonl",
    ".json": "json",
}
ACCEPTED = "CSV, TSV, JSON, JSONL, Parquet"

HASH_RANGE = 1 << 32
MAX_PARTS = (1 << 31) - 1  # an array's length is a 32-bit number


def once(value: Column, function) -> Column:
    """``function(value)`` with ``value`` computed once however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def not_blank(text: Column) -> Column:
    """True if the text holds a character that is not white space; false for null."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def words(text: Column, max_length: int) -> Column:
    """Lower-case words split at white space, cut to ``max_length`` words."""
    # One part more for an empty one before leading white space, and one for all that is cut off.
    parts = F.split(F.lower(text), r"(?U)\s+", min(max_length + 2, MAX_PARTS))
    return F.slice(F.filter(parts, lambda w: w != ""), 1, max_length)


def source_name(url: Column) -> Column:
    """File name of a URL: the last part of its path, or ``download``."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"^[A-Za-z][\w+.-]*://[^/]*", "")
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(F.length(name) > 0, name).otherwise("download")


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; empty when there is none."""
    base = F.regexp_replace(name, r"(?s)[?#].*$", "")
    # A leading dot starts a hidden name and a trailing one ends it; neither makes a suffix.
    return F.lower(F.regexp_extract(base, r"[^/.][^/]*?(\.[^./]+)$", 1))


def format_name(name: Column) -> Column:
    """Reader selected by a file name, or null for a suffix that is not accepted."""
    kind = suffix(name)
    choice = None
    for ending, fmt in FORMATS.items():
        hit = kind == ending
        choice = F.when(hit, fmt) if choice is None else choice.when(hit, fmt)
    return choice


def hash32(seed: int, key: Column) -> Column:
    """Seeded hash of a key in ``[0, 2**32)``, the same on every engine with MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fingerprint(server: Column, tool: Column, args: Column) -> Column:
    """SHA-256 of the JSON list ``[server, tool, args]``; ``args`` is JSON text already."""

    def quoted(c: Column) -> Column:
        # JSON functions write no bare text, so it is cut out of {"v":"..."}.
        json = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return once(json, lambda text: F.substring(text, F.lit(6), F.length(text) - 6))

    parts = F.concat_ws(",", quoted(server), quoted(tool), F.coalesce(args, F.lit("null")))
    return F.sha2(F.concat(F.lit("["), parts, F.lit("]")), 256)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never negative; null without a start."""
    return F.greatest(F.lit(0), F.floor(end - start + 0.5)).cast("bigint")
