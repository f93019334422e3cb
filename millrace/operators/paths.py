"""File paths named in the JSON arguments of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import checkpointed

# Fixed value: an argument key containing one of these words may hold a path.
PATH_WORDS = "(?i)path|file|dir|folder|source|destination|target|dest"

#: The JSON reader gives up at this many nested values.
_READER_LEVELS = 1000
#: Only texts with such a piece can hold an absolute path; a slash may be written as an escape.
_ABSOLUTE = r'"(\\?/|\\u002[fF])'


def _opening(text: Column) -> Column:
    return F.substring(F.ltrim(F.translate(text, "\r\n\t", "   ")), 1, 1)


def _children(frontier: DataFrame) -> DataFrame:
    """One row per value inside a nested value: ``id, hint, text, kind, at``.

    ``text`` is the value as JSON, a string without its quotes; ``kind`` its first character
    as JSON. Keys and items keep their written order. Items of a list inherit its key.
    """
    text = F.col("text")
    listed = _opening(text) == "["
    names = F.from_json(text, "map<string,string>")
    kinds = F.from_json(text, "map<string,variant>")
    first = lambda value: F.substring(F.to_json(value), 1, 1)
    items = F.when(
        listed,
        F.arrays_zip(
            F.transform(F.from_json(text, "array<string>"), lambda x: F.col("hint")).alias("hint"),
            F.from_json(text, "array<string>").alias("text"),
            F.transform(F.from_json(text, "array<variant>"), first).alias("kind"),
        ),
    ).otherwise(
        F.arrays_zip(
            F.map_keys(names).alias("hint"),
            F.map_values(names).alias("text"),
            F.transform(F.map_values(kinds), first).alias("kind"),
        )
    )
    return frontier.select("id", "at", F.posexplode_outer(items).alias("place", "item")).select(
        "id",
        F.col("item.hint").alias("hint"),
        F.col("item.text").alias("text"),
        F.col("item.kind").alias("kind"),
        F.when(F.col("place").isNotNull(), F.concat("at", F.array("place"))).alias("at"),
    )


def argument_paths(calls: DataFrame, id_column: str = "id", args_column: str = "args", levels: int = 200) -> DataFrame:
    """``id``, ``position``, ``path``: absolute paths under path-like keys, in first-seen order.

    Nested values are opened level by level, all calls at once, until none is left that could
    hold a path. A call nested too deep to tell (beyond ``levels``, or what the reader takes)
    has one row without path and position: it must not count as a call without paths.
    Arguments that are null, no JSON, or a bare value have no paths. Ids are unique.
    """
    frontier = calls.select(
        F.col(f"`{id_column}`").alias("id"), F.lit("").alias("hint"), F.col(f"`{args_column}`").alias("text"),
        F.array().cast("array<int>").alias("at"),
    )
    nested = _opening(F.col("text")).isin("{", "[") & F.col("text").rlike(_ABSOLUTE)
    frontier = checkpointed(frontier.where(nested), "arguments")
    # What the reader cannot open is no JSON, unless it is very deep.
    brackets = F.length("text") - F.length(F.translate("text", "[{", ""))
    unread = F.when(_opening(F.col("text")) == "[", F.from_json("text", "array<string>").isNull()).otherwise(
        F.from_json("text", "map<string,string>").isNull()
    )
    unknown = [frontier.where((brackets >= _READER_LEVELS) & unread).select("id")]
    found = []
    for _ in range(levels):
        if frontier.isEmpty():
            break
        values = checkpointed(_children(frontier).where(F.col("kind").isin('"', "{", "[")), "values")
        named = (F.col("kind") == '"') & F.col("text").startswith("/") & F.col("hint").rlike(PATH_WORDS)
        found.append(values.where(named).select("id", "at", F.col("text").alias("path")))
        frontier = values.where(F.col("kind").isin("{", "[") & F.col("text").rlike(_ABSOLUTE)).drop("kind")
    else:
        unknown.append(frontier.select("id"))
    missing = unknown[0]
    for more in unknown[1:]:
        missing = missing.unionByName(more)
    missing = missing.distinct().select("id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("path"))
    if not found:
        return missing
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    along = Window.partitionBy("id").orderBy("at")
    known = (
        paths.groupBy("id", "path").agg(F.min("at").alias("at"))
        .join(missing.select("id"), "id", "left_anti")
        .select("id", (F.row_number().over(along) - 1).alias("position"), "path")
    )
    return known.unionByName(missing)
