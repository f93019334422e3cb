"""Trie of conversation prefixes by a skeleton of splitters.

A conversation is a path of turn digests. Paths are sorted over shards; the paths at which
shards begin are the splitters, and their trie is the skeleton, which every task knows. All
conversations of a prefix are neighbours in the order, so a node whose conversations lie in
several shards is a prefix of a splitter. All other nodes are finished by the one sorted walk
of their shard; for the skeleton's nodes every shard leaves a partial aggregate.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import numbered
from millrace.llm.registry import query, table
from millrace.session import checkpointed

#: Bytes of the digest of one turn.
WIDTH = 16
#: Bytes of all splitters at most; beyond that every second one is left out until they fit.
SKELETON_BYTES = 8 << 20
#: Candidates of which one becomes a splitter.
_SAMPLE = 8
#: Turns of a shard: at least and, from 4096 shards on, about.
_FEW, _MANY, _SHARDS = 256, 1 << 16, 4096
_PIECE = 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = (
    "kind int, conv_id bigint, depth bigint, splitter bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, shard bigint, piece bigint"
)
_LOCAL, _PARTIAL, _ENDS = 0, 1, 2


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 of a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said, 256), 1, 2 * WIDTH))


def sequences(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``keys`` and ``sizes``: digests and UTF-8 bytes of a conversation's turns in order.

    Turns of equal order go by digest, null orders come first, a null role or text is empty.
    Rows without a conversation id belong to no conversation. Other columns are ignored.
    A conversation is one row of 20 bytes a turn, so it must have less than 70 million turns.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    turn = F.struct(
        F.col(f"`{order}`").alias("at"), turn_digest(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("key"), size.alias("size")
    )
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").alias("conv"), turn.alias("turn"))
    of_conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return of_conv.select("conv", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))


class Skeleton:
    """Trie of the splitters: sorted pairs of a path and a conversation.

    A node is the first splitter that has it and its depth.
    """

    def __init__(self, splitters: Sequence[tuple[bytes, int, Sequence[int]]]):
        splitters = sorted(splitters)
        paths = [path for path, _, _ in splitters]
        self.splitters = [(path, conv) for path, conv, _ in splitters]
        self.sizes = [list(sizes) for _, _, sizes in splitters]
        self.shared = [0] + [common(a, b) for a, b in zip(paths, paths[1:])]
        # The first splitter of every depth of a path, as far as it is shared with the one before.
        self._first: list[list[int]] = []
        for n, path in enumerate(paths):
            before = self._first[-1][: self.shared[n] + 1] if n else [0]
            self._first.append(before + [n] * (len(path) // WIDTH + 1 - len(before)))

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def around(self, shard: int) -> list[tuple[int, bytes]]:
        """The splitters a shard lies between."""
        return [(n, self.splitters[n][0]) for n in (shard - 1, shard) if 0 <= n < len(self.splitters)]

    def node(self, splitter: int, depth: int) -> int:
        return self._first[splitter][depth] if self.splitters else 0

    def nodes(self) -> dict[tuple[int, int], int]:
        """Size of the last turn of every node."""
        found = {(0, 0): 0}
        for n, first in enumerate(self._first):
            found |= {(n, depth): self.sizes[n][depth - 1] for depth in range(self.shared[n] + 1, len(first))}
        return found


def common(a: bytes, b: bytes) -> int:
    """Number of leading turns two paths share."""
    end = min(len(a), len(b))
    if a[:end] == b[:end]:
        return end // WIDTH
    low, high = 0, end // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * WIDTH] == b[: middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


class _Shard:
    """The sorted walk over the conversations of one shard."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.around = shard, skeleton, skeleton.around(shard)
        self.path = b""
        self.fields = {f: array("q") for f in ("conv", "depth", "splitter", "parent", "convs", "children", "leaves", "saved", "size")}
        self.ends: list[str | None] = []
        self.pieces: list[tuple[int, int, str]] = []
        self.open: list[int] = []
        self.hashes: list = []
        self._enter(0, 0, 0)

    def _enter(self, depth: int, size: int, splitter: int) -> None:
        f = self.fields
        f["parent"].append(self.open[-1] if self.open else -1)
        self.open.append(len(self.ends))
        self.hashes.append(None)
        f["conv"].append((1 << 63) - 1)
        f["depth"].append(depth)
        f["splitter"].append(splitter)
        f["size"].append(size)
        for name in ("convs", "children", "leaves", "saved"):
            f[name].append(0)
        self.ends.append(None)

    def _leave(self) -> None:
        f, n, ended = self.fields, self.open.pop(), self.hashes.pop()
        up, here = f["parent"][n], f["splitter"][n] < 0
        if here:
            f["leaves"][n] += f["children"][n] == 0
            f["saved"][n] += (f["convs"][n] - 1) * f["size"][n]
            self.ends[n] = ended.hexdigest() if ended else _NOTHING
        else:
            f["saved"][n] += f["convs"][n] * f["size"][n]
            if ended:
                self.pieces.append((n, len(self.pieces), ",".join(ended)))
        if up >= 0:
            f["children"][up] += here
            f["conv"][up] = min(f["conv"][up], f["conv"][n])
            for name in ("convs", "leaves", "saved"):
                f[name][up] += f[name][n]

    def add(self, conv: int, path: bytes, sizes: Sequence[int]) -> None:
        shared = common(self.path, path)
        while len(self.open) > shared + 1:
            self._leave()
        known = [(common(other, path), n) for n, other in self.around]
        for depth in range(shared + 1, len(path) // WIDTH + 1):
            splitter = next((self.skeleton.node(n, depth) for reach, n in known if depth <= reach), -1)
            self._enter(depth, sizes[depth - 1], splitter)
        self.path, n = path, self.open[-1]
        self.fields["conv"][n] = min(self.fields["conv"][n], conv)
        self.fields["convs"][n] += 1
        if self.fields["splitter"][n] < 0:
            if self.hashes[-1] is None:
                self.hashes[-1] = hashlib.sha256(str(conv).encode())
            else:
                self.hashes[-1].update(f",{conv}".encode())
        else:
            if self.hashes[-1] is None:
                self.hashes[-1] = []
            self.hashes[-1].append(str(conv))
            if len(self.hashes[-1]) >= _PIECE // 16:
                self.pieces.append((n, len(self.pieces), ",".join(self.hashes[-1])))
                self.hashes[-1] = None

    def batches(self) -> Iterator[pa.RecordBatch]:
        while self.open:
            self._leave()
        f, shard = self.fields, self.shard
        for start in range(0, len(self.ends), 10_000):
            span = range(start, min(start + 10_000, len(self.ends)))
            up = [f["parent"][n] for n in span]
            above = [f["splitter"][u] if u >= 0 else -1 for u in up]
            local = [f["splitter"][n] < 0 for n in span]
            yield _batch(
                kind=[_LOCAL if own else _PARTIAL for own in local],
                conv_id=f["conv"][start : span.stop],
                depth=f["depth"][start : span.stop],
                # Of a local node that of its parent, if the skeleton has that.
                splitter=[(a if a >= 0 else None) if own else f["splitter"][n] for own, a, n in zip(local, above, span)],
                parent_conv_id=[f["conv"][u] if own and a < 0 else None for own, a, u in zip(local, above, up)],
                n_convs=f["convs"][start : span.stop],
                n_children=f["children"][start : span.stop],
                n_leaves=f["leaves"][start : span.stop],
                saved_tokens=f["saved"][start : span.stop],
                ends=self.ends[start : span.stop],
                shard=[shard] * len(span),
            )
        for n, piece, text in self.pieces:
            yield _batch(kind=[_ENDS], depth=[f["depth"][n]], splitter=[f["splitter"][n]], ends=[text], shard=[shard], piece=[piece])


def _batch(**columns) -> pa.RecordBatch:
    fields = [pair.split() for pair in _NODE.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    rows = len(columns["kind"])
    arrays = [pa.array(columns.get(name, [None] * rows), kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _deal(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv").to_pylist())
            shards = pa.array([skeleton.value.shard(path, conv) for path, conv in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, shards], names=[*batch.schema.names, "shard"])

    return run


def _walk(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Shard | None = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "conv", "path", "sizes"))
            for shard, conv, path, sizes in zip(*columns):
                if now is None or now.shard != shard:
                    if now:
                        yield from now.batches()
                    now = _Shard(shard, skeleton.value)
                now.add(conv, path, sizes)
        if now:
            yield from now.batches()

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of every node, piece by piece in order."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])],
            names=["splitter", "depth", "ends"],
        )

    node, digest = None, None
    for batch in batches:
        for splitter, depth, text in zip(*(batch.column(c).to_pylist() for c in ("splitter", "depth", "ends"))):
            if (splitter, depth) != node:
                if node:
                    yield done()
                node, digest = (splitter, depth), hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
    if node:
        yield done()


def _splitters(paths: DataFrame, conversations: int, shards: int) -> list[tuple[bytes, int, list[int]]]:
    """About ``shards - 1`` evenly placed paths, conversations and turn sizes, of ``SKELETON_BYTES`` at most.

    Candidates are chosen by a hash of the conversation, so reruns agree. They decide only
    where shards begin, never what is counted.
    """
    if shards < 2:
        return []
    share = min(1.0, _SAMPLE * shards / conversations)
    chosen = paths.where(F.pmod(F.xxhash64("conv"), F.lit(1 << 30)) < int(share * (1 << 30))).select("path", "conv", "sizes")
    step = max(1, round(conversations * share / shards))
    placed = numbered(chosen, [F.col("path").asc(), F.col("conv").asc()], "at", "candidates")
    placed = checkpointed(placed.where(F.col("at") % step == step - 1), "splitters")
    while True:
        size = placed.agg(F.sum(F.length("path") + 4 * F.size("sizes") + 8)).first()[0] or 0
        if size <= SKELETON_BYTES:
            return [(bytes(r.path), r.conv, r.sizes) for r in placed.select("path", "conv", "sizes").collect()]
        step *= 2
        placed = placed.where(F.col("at") % step == step - 1)


def _reduce(skeleton: Skeleton, sums: list) -> list[tuple]:
    """Finished nodes of the skeleton from the sums of the shards' partial aggregates."""
    sizes = skeleton.nodes()
    order = sorted(sizes, key=lambda node: -node[1])
    got = {(r.splitter, r.depth): r for r in sums}
    children = dict.fromkeys(order, 0)
    leaves, spent, parents = dict(children), dict(sizes), {}
    for node in order:
        if node[1]:
            parents[node] = (skeleton.node(node[0], node[1] - 1), node[1] - 1)
            children[parents[node]] += 1
    for node in order:
        leaves[node] += not (children[node] + got[node].children)
        if node in parents:
            leaves[parents[node]] += leaves[node]
            spent[parents[node]] += spent[node]
    return [
        (
            *node,
            got[node].conv,
            got[parents[node]].conv if node in parents else None,
            got[node].convs,
            got[node].children + children[node],
            got[node].leaves + leaves[node],
            got[node].saved - spent[node],
        )
        for node in order
    ]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Every node of the trie of ``paths`` (``conv``, ``keys``, ``sizes``; a ``conv`` has one row).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members),
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, members but one times
    the size of a node's last turn) and ``ends_sha256`` (of the ids, joined by commas, of the
    conversations that end there). No conversations, no nodes.

    A node of very many members is cut by splitters that hold the conversation id as well;
    equal conversations lie in the order of their ids. The ids that end at one node are
    hashed in that order by one task, 64 KB at a time, as a digest cannot be split.
    """
    spark = paths.sparkSession
    flat = paths.select("conv", F.array_join(F.transform("keys", F.hex), "").alias("hex"), "sizes")
    flat = checkpointed(flat.select("conv", F.unhex("hex").alias("path"), "sizes"), "paths")
    conversations, turns = flat.agg(F.count("*"), F.sum(F.size("sizes"))).first()
    shards = max(min((turns or 0) // _FEW, _SHARDS), (turns or 0) // _MANY, 1)
    skeleton = Skeleton(_splitters(flat, conversations, shards))
    shared = spark.sparkContext.broadcast(skeleton)
    dealt = flat.mapInArrow(_deal(shared), "conv bigint, path binary, sizes array<int>, shard bigint")
    sorted_shards = dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv")
    nodes = checkpointed(sorted_shards.mapInArrow(_walk(shared), _NODE), "nodes")
    partial = nodes.where(F.col("kind") == _PARTIAL).groupBy("splitter", "depth").agg(
        F.min("conv_id").alias("conv"), F.sum("n_convs").alias("convs"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
    )
    finished = _reduce(skeleton, partial.collect()) if conversations else []
    top = spark.createDataFrame(
        finished,
        "splitter bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint",
    )
    ends = (
        nodes.where(F.col("kind") == _ENDS)
        .repartition("splitter", "depth")
        .sortWithinPartitions("splitter", "depth", "shard", "piece")
        .select("splitter", "depth", "ends")
        .mapInArrow(_hash_ends, "splitter bigint, depth bigint, ends string")
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = top.join(ends, ["splitter", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NOTHING)))
    # The skeleton's size is bounded by SKELETON_BYTES.
    known = F.broadcast(top.select(F.col("splitter"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("__up")))
    local = (
        nodes.where(F.col("kind") == _LOCAL)
        .join(known, ["splitter", "depth"], "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__up"))
        .withColumn("ends_sha256", F.col("ends"))
    )
    return local.select(*columns).unionByName(upper.select(*columns))


def rebuilt(paths: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """``paths`` whose conversations begin as another of their group does.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % group`` (all it has, none if it
    is absent) for its own first ``h``; ``h`` is the unsigned CRC32 of its decimal id modulo
    ``most + 1``. At most ``group`` conversations meet one base, of which ``most`` turns move.
    """
    base = paths.select(
        F.col("conv").alias("__base"), F.slice("keys", 1, most).alias("__keys"), F.slice("sizes", 1, most).alias("__sizes")
    )
    taken = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (most + 1)).cast("int")

    def swapped(own: str, other: str) -> Column:
        kept = F.slice(F.col(own), F.col("__taken") + 1, F.greatest(F.size(own), F.lit(1)))
        return F.concat(F.slice(F.coalesce(F.col(other), F.slice(own, 1, 0)), F.lit(1), F.col("__taken")), kept)

    joined = paths.join(base, F.col("conv") - F.col("conv") % group == F.col("__base"), "left").withColumn("__taken", taken)
    return joined.select("conv", swapped("keys", "__keys").alias("keys"), swapped("sizes", "__sizes").alias("sizes"))


_STEPS = ", ".join(["1"] * 8)
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), {_STEPS}]::BIGINT[], lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
         octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT c.conv_id, t.place, t.said, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.h
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT t.conv_id, t.place - c.h + (SELECT count(*) FROM heads b WHERE b.conv_id = c.conv_id), t.said, t.size
  FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE t.place > c.h
), steps AS (
  SELECT conv_id, place AS depth, size, sha256(array_to_string(list(sha256(said)) OVER (PARTITION BY conv_id ORDER BY place), '')) AS node
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM convs
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up,
         lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM steps
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM linked GROUP BY node
), kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT s.node, sum((n.n_convs - 1) * n.size) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth LEFT JOIN kids k ON k.node = n.node
  GROUP BY s.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.up
"""


@query("op13_prefix_trie", ORACLE)
def conversation_trie(spark, sf_dir):
    """Every distinct beginning of the rebuilt conversations."""
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))
