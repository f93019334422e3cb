"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string is the one chain of tokens in which every two neighbours would
stay apart when encoded alone (published by van Antwerpen and Neubeck). So the encoding of
every prefix is known from its last token: it is the token that ends there and may follow the
last token of what remains before it. Appending bytes only adds entries, and an edit leaves
the entries before it as they are.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import Cache, chunks, id_lists, texts
from millrace.llm.registry import query, table
from millrace.llm.words import release


class _Halves(dict):
    """The two tokens whose merge makes a token: (-1, -1) for a byte, None if merging never makes it."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: int) -> tuple[int, int] | None:
        piece, made = self.encoder.bytes[token], (-1, -1)
        if len(piece) > 1:
            parts = self.encoder.merged(piece, 2)
            made = tuple(parts) if len(parts) == 2 and self.encoder.merged(piece) == [token] else None
        self[token] = made
        return made


class PrefixEncoder:
    """Encoder and decoder for a table of token bytes and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 600_000):
        import ahocorasick
        import regex

        self.ranks, self.most = ranks, most
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.match = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.done: dict[str, bytes] = {}
        self.halves = _Halves(self)
        # Finds all tokens that end at each byte; bytes are put as characters of the same number.
        self.tokens = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens.add_word(token.decode("latin-1"), (rank, len(token)))
        self.tokens.make_automaton()
        size = max(self.bytes, default=-1) + 1
        lengths = np.array([len(self.bytes.get(i, b"")) for i in range(size)], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.cache = Cache(self.encode_chunk, most // 2)

    @classmethod
    def load(cls, path: str, pattern: str) -> PrefixEncoder:
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def merged(self, piece: bytes, until: int = 1) -> list[int]:
        """Encoding by its definition: join the neighbours of lowest rank, leftmost first.

        It ends early when no more than ``until`` parts are left.
        """
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            low = min((r for r in found if r is not None), default=None)
            if low is None:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, left: int, token: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged together.

        Merges happen in order of rank, so go back in time: as long as the two tokens at the
        border both exist, a merge across it must not be due before the next merge that takes
        one of them in. Of equal ranks the one further left is due first.
        """
        ranks, names, halves = self.ranks, self.bytes, self.halves
        due = len(self.lengths) + 1
        while True:
            across = ranks.get(names[left] + names[token])
            if across is not None and across < due:
                return False
            # The younger of the two is taken apart; a single byte never is.
            a, b = halves[left], halves[token]
            if a[0] >= 0 and (b[0] < 0 or left > token):
                due, left = left, a[1]
            elif b[0] >= 0:
                due, token = token + 1, b[0]
            else:
                return True

    def extend(self, piece: bytes, table: list[int]) -> list[int]:
        """Add the last token of every longer prefix of ``piece`` to those in ``table``."""
        pairs, halves, done = self.pairs, self.halves, len(table)
        for end, (token, size) in self.tokens.iter(piece.decode("latin-1"), max(0, done - self.longest + 1)):
            if end < done:
                continue
            if end > done:
                break
            begin = end + 1 - size
            if begin:
                pair = table[begin - 1] << 32 | token
                apart = pairs.get(pair)
                if apart is None:
                    if len(pairs) >= self.most:
                        pairs.clear()
                    apart = pairs[pair] = halves[token] is not None and self._follows(table[begin - 1], token)
                if not apart:
                    continue
            elif halves[token] is None:
                continue
            table.append(token)
            done += 1
        if done < len(piece):
            raise ValueError("no token of the table ends here; single bytes are missing")
        return table

    def chain(self, table: list[int]) -> list[int]:
        """Tokens of the whole piece, read back from the last token of each prefix."""
        out, n = [], len(table)
        while n:
            out.append(table[n - 1])
            n -= len(self.bytes[table[n - 1]])
        return out[::-1]

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.chain(self.extend(piece, []))

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit bytes; short matches are kept for later chunks."""
        done, out = self.done, []
        for match in self.match(chunk):
            ids = done.get(match)
            if ids is None:
                ids = array("I", self.piece(match.encode())).tobytes()
                if len(match) <= 48:
                    if len(done) >= self.most:
                        done.clear()
                    done[match] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.cache.ids(text), np.uint32).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from the table in blocks of ids."""
        out = []
        for start in range(0, len(ids), 1 << 16):
            part = ids[start : start + (1 << 16)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.begins[part] - (ends - lengths), lengths)
            out.append(self.blob[shift + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class EditedText:
    """A text with the prefix entries of its pieces, kept exact under appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder = encoder
        self.parts: list[tuple[str, list[tuple[bytes, list[int]]]]] = []
        self.parts = self._parts(text, [])

    @property
    def text(self) -> str:
        return "".join(chunk for chunk, _ in self.parts)

    @property
    def ids(self) -> list[int]:
        encoder, out = self.encoder, []
        for _, pieces in self.parts:
            for piece, table in pieces:
                whole = encoder.ranks.get(piece)
                out += [whole] if whole is not None else encoder.chain(table)
        return out

    def _parts(self, text: str, old: list[tuple[bytes, list[int]]]):
        """Chunks of a stretch; pieces that begin like an old one take over its common entries."""
        made, queue = [], list(old)
        for chunk in chunks(text):
            pieces = []
            for match in self.encoder.match(chunk):
                piece, kept = match.encode(), []
                for n, (before, table) in enumerate(queue):
                    same = next((i for i, (a, b) in enumerate(zip(piece, before)) if a != b), min(len(piece), len(before)))
                    if same:
                        kept, queue = table[:same], queue[n + 1 :]
                        break
                pieces.append((piece, self.encoder.extend(piece, kept)))
            made.append((chunk, pieces))
        return made

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Replace the characters from ``start`` to ``end``; only chunks they touch are encoded anew."""
        sizes = np.cumsum([0] + [len(chunk) for chunk, _ in self.parts])
        first = max(int(np.searchsorted(sizes, start, "right")) - 2, 0)
        stop = min(int(np.searchsorted(sizes, end, "left")) + 1, len(self.parts))
        touched = self.parts[first:stop]
        stretch = "".join(chunk for chunk, _ in touched)
        offset = int(sizes[first]) if len(self.parts) else 0
        new = stretch[: start - offset] + text + stretch[end - offset :]
        old = [entry for _, pieces in touched for entry in pieces]
        self.parts[first:stop] = self._parts(new, old)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PrefixEncoder:
    """One encoder, with its caches, for all tasks of a Python worker."""
    encoder = PrefixEncoder.load(path, pattern)
    # Its tables live as long as the worker; without this every full collection walks them.
    gc.freeze()
    gc.set_threshold(50_000, 20, 50)
    return encoder


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern used unless others are given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(
    docs: DataFrame, text_column: str = "text", ids_column: str = "ids", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each whole text as ``array<int>``.

    The vocabulary file must exist under its path on every executor. Null texts count as empty
    and give an empty list; a column that already has the name of the ids is replaced.
    """
    default = vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    kept = [c for c in docs.columns if c.lower() != ids_column.lower()]
    flat = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").alias("__encoded"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for start, part in texts(batch.column(batch.num_columns - 1)):
                rows = batch.slice(start, len(part))
                found = id_lists([encoder.cache.ids(t) for t in part])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], found], names=[*batch.schema.names[:-1], ids_column]
                )
        release()

    return flat.mapInArrow(run, ", ".join(x for x in (kinds, f"`{ids_column}` array<int>") if x))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.uint32, copy=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def decode_ids(
    docs: DataFrame, ids_column: str = "ids", path: str | None = None, pattern: str | None = None, digests: bool = False
) -> DataFrame:
    """``docs`` with ``decoded``, the bytes of the ids; null lists give no bytes.

    With ``digests`` the bytes stay in the task, and ``n_tokens``, ``ids_sha256`` (of
    little-endian 32-bit ids) and ``decoded_sha256`` take the place of ids and bytes.
    """
    default = vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "decoded binary"
    gone = {"n_tokens", "ids_sha256", "decoded_sha256", ids_column.lower()} if digests else {"decoded"}
    kept = [c for c in docs.columns if c.lower() not in gone]
    flat = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_column}`").alias("__ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                lists = list(_lists(rows.column(rows.num_columns - 1)))
                if digests:
                    columns = [
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists]),
                        pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in lists]),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns, names = [pa.array([encoder.decode(x) for x in lists], pa.binary())], ["decoded"]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], *names]
                )
        release()

    return flat.mapInArrow(run, ", ".join(x for x in (kinds, added) if x))


@query("op7_prefix_bpe")
def prefix_bpe(spark, sf_dir):
    """Ids of every whole text and the bytes decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs).select("doc_id", "ids")
    return decode_ids(encoded, digests=True)
