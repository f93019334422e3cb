"""Glob patterns (``read*|list*``) as anchored, case-insensitive regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(patterns: Column) -> Column:
    """Regular expression text for a column of glob patterns."""
    parts = F.transform(F.split(patterns, r"\|"), lambda p: F.trim(p))
    special = r"([.+?^${}()\[\]\\])"
    escaped = F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.regexp_replace(F.regexp_replace(p, special, r"\\$1"), r"\*", ".*"),
    )
    return F.concat(F.lit("(?i)^(?:"), F.array_join(escaped, "|"), F.lit(r")\z"))


def glob_regex(pattern: str) -> str:
    """The same for one pattern known when the plan is built."""
    parts = [p.strip() for p in pattern.split("|")]
    alternatives = [".*".join(re.escape(piece) for piece in p.split("*")) for p in parts if p]
    return rf"(?i)^(?:{'|'.join(alternatives)})\z"
