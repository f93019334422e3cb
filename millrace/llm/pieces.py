"""Splitting texts for byte-level BPE, and encoding them through a cache of their chunks.

A chunk starts at a space before a character that is no white space. The usual pattern always
starts a match there and never looks further back or ahead, so chunks can be encoded one by
one; most occur again and again and are encoded once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: White space for ``str``, a superset of what the pattern knows: wider only means longer chunks.
_LONE = re.compile(r" (?=[\s᠎]|$)")
_SAFE = re.compile(r" (?=[^\s᠎])")
#: Longest chunk that is kept.
_LONG = 64


def chunks(text: str) -> list[str]:
    """The text cut before every space that a character other than white space follows."""
    parts = _SAFE.split(text) if _LONE.search(text) else text.split(" ")
    head = [parts[0]] if parts[0] else []
    return head + [" " + p for p in parts[1:]]


class Cache(dict):
    """Ids of chunks as little-endian 32-bit bytes; ``encode`` is asked for those not seen yet.

    Keys are chunks without their leading space. At ``most`` entries it starts anew; chunks of
    more than ``_LONG`` characters are not kept, so its size is bounded in bytes as well.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.encode(" " + key)
        if len(key) <= _LONG:
            self[key] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text."""
        parts = _SAFE.split(text) if _LONE.search(text) else text.split(" ")
        head = self.encode(parts[0]) if parts[0] else b""
        return head + b"".join(map(self.__getitem__, parts[1:]))


def texts(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of small slices of a column; null counts as empty."""
    for start in range(0, len(column), rows):
        yield start, [t or "" for t in column.slice(start, rows).to_pylist()]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """A column of id lists from the bytes of each."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
