"""Words of whole texts as 64-bit hashes, computed on Arrow buffers.

A word is a run of bytes above 0x20. Work goes block by block of about 2 MB of text, so memory
stays bounded whatever the size of a batch; one longer text is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21
_BASE = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give memory that a task has freed back to the system; its worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has its own way
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row (exclusive), bytes and row offsets of each block."""
    data, offsets = utf8(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of every text (and the end)."""
    inside = data > 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of the first word of every text (and the end)."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    chars = data[data > 32].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(chars * powers[place], begin)), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the runs of ``k`` words in text order, and the first of each text.

    A text of fewer words has one run, all its words; a text without words has none. The n-th
    repetition of a run within a text gets a hash of its own.
    """
    counts = np.diff(first)
    runs = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(begin[-1]) - begin[text] + first[text]
    last = first[text + 1]
    h = words[at]
    factor = _ODD
    with np.errstate(over="ignore"):
        for j in range(1, k):
            here = at + j
            h = h + np.where(here < last, words[np.minimum(here, len(words) - 1)], np.uint64(0)) * factor
            factor = np.uint64(int(factor) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)
    h = mix(h)
    own = h ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        numbers = np.arange(len(ranked))
        seen = numbers - np.maximum.accumulate(np.where(new, numbers, 0))
        nth = np.empty(len(h), np.uint64)
        nth[order] = seen.astype(np.uint64)
        h = np.where(nth > 0, mix(h + nth * _ODD), h)
    return h, begin
