"""Token ids in grammar-compressed shards (Re-Pair, published by Larsson and Moffat).

Documents in ascending id are encoded and cut into shards. In every shard frequent pairs of
neighbouring symbols are replaced by new symbols, round after round, never across the end of
a document. A shard is one row of a Parquet table: its rules, the length each symbol expands
to, the remaining symbols, and where every document starts among them, so any document, or
any range of its ids, can be decoded alone.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.pieces import _LONE, _SAFE
from millrace.llm.registry import query, table
from millrace.llm.words import blocks, utf8
from millrace.session import workspace

SHARD_SCHEMA = (
    "part int, shard int, before bigint, base int, doc_ids array<bigint>, doc_starts array<int>, "
    "doc_tokens array<int>, rules binary, lengths binary, symbols binary"
)
_BITS = 20
#: The split of the library's byte-level tokenizers, and the characters that their models show bytes as.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSHOWN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN = [chr(256 + _UNSHOWN.index(b)) if b in _UNSHOWN else chr(b) for b in range(256)]


def compress(
    ids: np.ndarray, ends: np.ndarray, base: int, least: int = 4, gain: float = 0.005, step: int = 8
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs; rule n makes symbol ``base + n``), remaining symbols and their end marks.

    ``ends`` marks the last id of each document, which starts no pair. Each round counts all
    pairs and replaces, without overlap, those whose count reaches a bar that falls by ``step``
    a round, most frequent first. It ends when a round at the lowest bar, ``least``, shortens
    the sequence by less than ``gain``.
    """
    seq, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    count, bar, seed = 0, None, 0
    rank_of = np.zeros(1 << _BITS, np.int32)
    while len(seq) > 1:
        seed += 1
        key = seq[:-1].astype(np.uint64)
        key <<= np.uint64(32)
        key |= seq[1:]
        starts = ~ends[:-1]
        ordered = np.sort(key[starts])
        floor = least if bar is None else max(least, bar // step)
        while True:
            # A pair of ``floor`` places or more equals the one so many places further on.
            pairs = ordered[floor - 1 :]
            pairs = pairs[pairs == ordered[: len(pairs)]]
            runs = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
            found = np.diff(runs, append=len(pairs)) + floor - 1
            top = int(found.max(initial=0))
            if floor == least or top >= bar:
                break
            floor = least
        if top < least:
            break
        bar = max(least, top // step) if bar is None else max(least, min(bar, top) // step)
        chosen = np.flatnonzero(found >= bar)
        last = bar == least
        if len(chosen):
            chosen = chosen[np.argsort(-found[chosen], kind="stable")]
            none = len(chosen)
            pairs = pairs[runs[chosen]]
            # Places are found by hash; of pairs that share a slot the more frequent is met now, the others in a later round.
            odd = np.uint64((0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1)
            shift = np.uint64(64 - _BITS)
            slots = ((pairs * odd) >> shift).view(np.int64)
            rank_of[slots[::-1]] = np.arange(none - 1, -1, -1, dtype=np.int32)
            taken = np.zeros(1 << _BITS, bool)
            taken[slots] = True
            slot = key * odd
            slot >>= shift
            slot = slot.view(np.int64)
            near = np.flatnonzero(taken.take(slot) & starts)
            own = rank_of.take(slot.take(near))
            met = np.flatnonzero(pairs.take(own) == key.take(near))
            at, own = near.take(met), own.take(met)
            rank = np.full(len(slot) + 2, none, np.int32)
            rank[at + 1] = own
            # Of overlapping pairs the more frequent is taken, of equal ones the first.
            first = (own < rank.take(at)) & (own <= rank.take(at + 2))
            at, own = at[first], own[first]
            worth = np.bincount(own, minlength=none) >= 3
            stays = worth.take(own)
            at, own = at[stays], own[stays]
            kept = np.flatnonzero(worth)
            if len(kept):
                name = np.zeros(none, np.uint32)
                name[kept] = base + count + np.arange(len(kept))
                pairs = pairs[kept]
                rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
                count += len(kept)
                seq[at] = name[own]
                stay = np.ones(len(seq), bool)
                stay[at + 1] = False
                ends[at] = ends[at + 1]
                before = len(seq)
                seq, ends = seq[stay], ends[stay]
                if last and before - len(seq) < gain * before:
                    break
                continue
        if last:
            break
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq, ends


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids each rule expands to; a rule uses earlier symbols only."""
    out = np.zeros(len(rules), np.int64)
    open_ = np.arange(len(rules))
    while len(open_):
        pair = rules[open_].astype(np.int64) - base
        size = np.where(pair < 0, 1, out[np.maximum(pair, 0)])
        ready = (size > 0).all(axis=1)
        out[open_[ready]] = size[ready].sum(axis=1)
        open_ = open_[~ready]
    return out


def _unfold(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    out = symbols
    while True:
        big = out >= base
        if not big.any():
            return out
        sizes = np.where(big, 2, 1)
        at = np.cumsum(sizes) - sizes
        grown = np.repeat(out, sizes)
        pair = rules[out[big] - base]
        grown[at[big]] = pair[:, 0]
        grown[at[big] + 1] = pair[:, 1]
        out = grown


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that symbols stand for; where there are more symbols than rules, every rule unfolds once."""
    if len(symbols) <= len(rules) or not len(rules):
        return _unfold(symbols, rules, base)
    table = _unfold(np.arange(base, base + len(rules), dtype=symbols.dtype), rules, base)
    lengths = rule_lengths(rules, base)
    big = symbols >= base
    rule = symbols[big].astype(np.int64) - base
    sizes = np.ones(len(symbols), np.int64)
    sizes[big] = lengths[rule]
    out = np.repeat(symbols, sizes)
    own = lengths[rule]
    # Where each id of a rule lies in the table of all rules.
    place = np.repeat((np.cumsum(lengths) - lengths)[rule] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    out[np.repeat(big, sizes)] = table[place]
    return out


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive); only the symbols that cover them are expanded."""
    sizes = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    first = max(int(np.searchsorted(edges, start, "right")) - 1, 0)
    last = int(np.searchsorted(edges, stop, "left"))
    return expand(symbols[first:last], rules, base)[start - edges[first] : stop - edges[first]]


class WordEncoder:
    """Ids of texts by the ``tokenizers`` library, each distinct word encoded once per worker.

    Words and whole parts of texts have ``2 * most`` entries together, which start anew when full.
    """

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.size = self.tokenizer.get_vocab_size()
        self.match = regex.compile(pattern).findall
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        #: A match of this pattern is one word of the byte-level split, which the model alone encodes.
        self.plain = (
            pattern == _BYTE_LEVEL and not parts["normalizer"] and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space")
        )
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before; each is a match of the pattern."""
        if self.plain:
            tokenize, learnt = self.tokenizer.model.tokenize, self.words
            for word in words:
                if word.isascii() and word.isprintable():
                    shown = word.replace(" ", _SHOWN[32])
                else:
                    shown = "".join([_SHOWN[b] for b in word.encode()])
                learnt[word] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            return
        for word, found in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
            self.words[word] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes.

        The library gives the string of a special token the token's own id, so a text that holds
        one goes to the library as it is.
        """
        marked = [n for n, t in enumerate(texts) if any(s in t for s in self.special)]
        if marked:
            whole = self.tokenizer.encode_batch([texts[n] for n in marked], add_special_tokens=False)
            found = self.encode(["" if n in set(marked) else t for n, t in enumerate(texts)])
            for n, encoding in zip(marked, whole):
                found[n] = np.array(encoding.ids, np.uint32).tobytes()
            return found
        lone = [n for n, t in enumerate(texts) if _LONE.search(t)]
        if not lone:
            return self._of_parts(pc.split_pattern(pa.array(texts, pa.large_string()), " "))
        safe = pa.array([_SAFE.split(texts[n]) for n in lone], pa.list_(pa.large_string()))
        found = self.encode(["" if n in set(lone) else t for n, t in enumerate(texts)]) if len(lone) < len(texts) else [b""] * len(texts)
        for n, ids in zip(lone, self._of_parts(safe)):
            found[n] = ids
        return found

    def _of_parts(self, split: pa.ListArray) -> list[bytes]:
        """Ids of texts cut at spaces; the space belongs to the part after it.

        Parts that occur again in these texts are looked up once and kept, the others go by their words.
        """
        edges = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        whole, heads = coded.dictionary, edges[:-1]
        first = whole.take(coded.indices.take(pa.array(heads)))
        parts = coded.indices.to_numpy().copy()
        parts[heads] = len(whole) + np.arange(len(heads))
        met = np.bincount(parts, minlength=len(whole))[: len(whole)]
        often, once = np.flatnonzero(met > 1), np.flatnonzero(met == 1)
        place = np.zeros(len(whole) + len(heads), np.int64)
        place[np.concatenate([often, once, len(whole) + np.arange(len(heads))])] = np.arange(len(often) + len(once) + len(heads))
        kept, sizes = _joined(self._kept(_listed(whole.take(pa.array(often)))))
        rest, more = self._of_pieces(pa.concat_arrays([_spaced(whole.take(pa.array(once))), first]))
        ids, ends = _gathered(np.concatenate([kept, rest]), np.concatenate([sizes, more]), place[parts])
        return _cut(ids, np.concatenate([[0], ends])[edges])

    def _kept(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it."""
        known = self.chunks
        if len(known) > self.most:
            known.clear()
        new = [p for p in parts if p not in known]
        ids, sizes = self._of_pieces(_spaced(pa.array(new, pa.large_string())))
        known.update(zip(new, _cut(ids, np.concatenate([[0], np.cumsum(sizes)]))))
        return [*map(known.__getitem__, parts)]

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has; equal words of them are looked up once."""
        words, edges = self._split(pieces)
        coded = words.dictionary_encode()
        ids, ends = _gathered(*_joined(self._words(_listed(coded.dictionary))), coded.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], ends])[edges])

    def _split(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all pieces, and the number of the first word of every piece (and the end)."""
        if not self.plain:
            found = [self.match(p) for p in pieces.to_pylist()]
            return pa.array([w for f in found for w in f], pa.large_string()), np.cumsum([0, *map(len, found)])
        data, offsets = utf8(pieces)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.flatnonzero(data & 0xC0 != 0x80) if len(points) < len(data) else None
        opens = offsets if chars is None else np.searchsorted(chars, offsets)
        starts = word_starts(points, opens)
        places = np.append(starts if chars is None else chars[starts], len(data))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data))
        return words, np.searchsorted(starts, opens)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known = self.words
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > 2 * self.most - min(self.most, len(self.chunks)):
            # Words of these texts that were known go too, so they are learnt again.
            known.clear()
            missing = words
        if missing:
            self._learn(missing)
        return [*map(known.__getitem__, words)]


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with a space before each."""
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces and how many each has."""
    return np.frombuffer(b"".join(pieces), np.uint32), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def _gathered(ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces that ``parts`` numbers, one after another, and where each ends."""
    starts = np.cumsum(sizes) - sizes
    long = sizes[parts]
    ends = np.cumsum(long)
    return ids[np.repeat(starts[parts] - (ends - long), long) + np.arange(int(long.sum()))], ends


def _cut(ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Bytes of the ids between one edge and the next."""
    data, cuts = ids.tobytes(), (edges * 4).tolist()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Whether each code point is other (0), a letter (1), a number (2) or white space (3) to the byte-level split."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text, kinds = points.tobytes().decode("utf-32-le"), np.zeros(len(points), np.uint8)
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for found in regex.finditer(pattern, text):
            kinds[found.start() : found.end()] = kind
    return np.insert(kinds, 0xD800, np.zeros(0x800, np.uint8))


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-level split start in texts of code points that begin at ``offsets``."""
    kinds = _kinds()[points]
    opens = np.zeros(len(points) + 3, bool)  # texts
    opens[offsets] = True
    starts = opens[: len(points)].copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    # The last of white space before something else is a match of its own; a space goes with what follows.
    white = kinds == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~opens[1 : len(points)])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    # An apostrophe that starts a match takes one of some endings.
    at = np.flatnonzero(points == 39)
    at = at[starts[at] & ~opens[at + 1] & (at + 1 < len(points))]
    if len(at):
        one, two = points[at + 1], np.append(points, 0)[at + 2]
        double = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b)) & ~opens[at + 2]
        takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(double, 3, 0))
        at, takes = at[takes > 0], takes[takes > 0]
        starts[at + 1] = False
        after = at + takes
        starts[after[after < len(points)]] = True
    return np.flatnonzero(starts)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> WordEncoder:
    import gc
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    encoder = WordEncoder(path, pattern)
    # The tables live as long as the worker; a full collection need not walk them.
    gc.freeze()
    gc.set_threshold(100_000, 50, 100)
    return encoder


def vocabulary() -> tuple[str, str]:
    """Path of the tokenizer file and the pattern it splits by, unless others are given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def write_shards(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
    pattern: str | None = None, end_id: int = 2, shard_ids: int = 1 << 20,
) -> None:
    """Encode ``docs`` and write them as shards of about ``shard_ids`` ids in ascending id.

    Every document gets ``end_id`` appended. Rows are dealt out by range of id, then hash of the
    text, so a hot id is spread too and no text is sampled; null ids come first, null texts are
    empty, equal ids are ordered by that hash. The tokenizer file must exist under its path on every executor. A text with more
    ids than a shard gets a shard of its own.
    """
    default = vocabulary() if tokenizer is None or pattern is None else (tokenizer, pattern)
    tokenizer, pattern = tokenizer or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, pattern)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32).tobytes()
        names: list[int | None] = []
        parts: list[bytes] = []
        held, shard, before = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard, before, names, parts
            ids = np.frombuffer(b"".join(parts), np.uint32)
            tokens = np.array([len(p) // 4 for p in parts], np.int64)
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(tokens) - 1] = True
            rules, symbols, last = compress(ids, ends, encoder.size)
            starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype(np.int32)
            row = {
                "part": part, "shard": shard, "before": before, "base": encoder.size, "doc_ids": names,
                "doc_starts": starts, "doc_tokens": tokens.astype(np.int32), "rules": rules.tobytes(),
                "lengths": rule_lengths(rules, encoder.size).astype(np.uint32).tobytes(), "symbols": symbols.tobytes(),
            }
            shard, before, held, names, parts = shard + 1, before + len(ids), 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            for start, stop, _, _ in blocks(batch.column(1), 1 << 23):
                rows = batch.slice(start, stop - start)
                for name, found in zip(
                    rows.column(0).to_pylist(), encoder.encode([t or "" for t in rows.column(1).to_pylist()])
                ):
                    if held and held + len(found) // 4 >= shard_ids:
                        yield flush()
                    names.append(name)
                    parts.append(found + end)
                    held += len(found) // 4 + 1
        if parts:
            yield flush()

    (
        docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h", "text")
        .select("id", "text")
        .mapInArrow(run, SHARD_SCHEMA)
        .write.option("compression", "zstd").parquet(path)
    )


_SHARD = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("base", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int32())),
        ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
    ]
)


def read_documents(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    With ``digests`` the ids stay in the task and ``ids_crc32`` takes their place. Shards know
    the ids before them in their part; sums over the parts, one row for each written range, do the rest.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select(
        "part", F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")
    ).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    out = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()),
         ("ids_crc32", pa.int64()) if digests else ("ids", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                rules = np.frombuffer(row["rules"].as_buffer(), np.uint32).reshape(-1, 2)
                symbols = np.frombuffer(row["symbols"].as_buffer(), np.uint32)
                ids = expand(symbols, rules, row["base"].as_py())
                tokens = row["doc_tokens"].values.to_numpy().astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(tokens)])
                if digests:
                    data = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
                count = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, row["part"].as_py(), np.int32)), row["doc_ids"].values,
                        pa.array(edges[:-1] + row["before"].as_py()), pa.array(tokens), last,
                    ],
                    schema=out,
                )

    kind = "ids_crc32 bigint" if digests else "ids array<int>"
    read = shards.mapInArrow(run, f"part int, doc_id bigint, within bigint, n_tokens bigint, {kind}")
    return read.join(parts, "part").select(
        "doc_id", (F.col("__start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32" if digests else "ids"
    )


@query("op1_repair")
def repair(spark, sf_dir):
    """Every document's place, length and checksum, read back from grammar-compressed shards."""
    path = workspace(spark, "repair")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path, digests=True)
