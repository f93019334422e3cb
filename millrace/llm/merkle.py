"""Merkle manifest of a dataset by nested-interval labels, in DataFrame functions only.

Leaves are numbered along sources and ids. A node carries the interval ``[lo, hi)`` of leaf
numbers it covers; 16 consecutive nodes of a tree form the node above them. A node finds its
parent by a containment join of intervals, bucketed by level and run, and its siblings by the
difference: of the parent's children those before ``lo`` and those from ``hi`` on. Every
source is a tree, and the tops of the sources are the leaves of one further tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import numbered
from millrace.llm.registry import query, table
from millrace.session import checkpointed

FAN = 16
#: Leaves and branches meet in cells of so many (a power of two) neighbouring leaves.
CELL_BITS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of a record; no two different records have the same input."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _joined(children: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(children, keep), lambda c: c["hash"]), "")


def grow(nodes: DataFrame, longest: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of trees from their leaves up, and the top of every tree.

    ``nodes``: ``tree``, ``k`` (place in the tree from 0), ``n`` (nodes of this level of the
    tree), ``lo``, ``hi``, ``hash``. ``longest``: leaves of the largest tree. Level 0 is
    ``nodes``; a node above also has ``children``, at most 16 structs of ``lo, hi, hash`` in
    order. A tree ends at the level where it has one node.
    """
    levels, level = [nodes], nodes
    tops = [nodes.where("n = 1").select("tree", "lo", "hi", "hash")]
    while longest > 1:
        longest = -(-longest // FAN)
        run = (
            level.where("n > 1")
            .groupBy("tree", F.floor(F.col("k") / FAN).cast("bigint").alias("k"))
            .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "hash"))).alias("children"), F.first("n").alias("n"))
            .select(
                "tree",
                "k",
                F.ceil(F.col("n") / FAN).cast("bigint").alias("n"),
                F.col("children")[0]["lo"].alias("lo"),
                F.element_at("children", -1)["hi"].alias("hi"),
                F.sha2(_joined(F.col("children"), lambda c: F.lit(True)), 256).alias("hash"),
                "children",
            )
        )
        level = checkpointed(run, label)
        levels.append(level)
        tops.append(level.where("n = 1").select("tree", "lo", "hi", "hash"))
    top = tops[0]
    for other in tops[1:]:
        top = top.unionByName(other)
    return levels, top


def attach(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: what lies left and right of them in their run, then their parent's path.

    The bucket of a containment join is the run of a level, so both sides have at most 16
    rows of a bucket, whatever the size of a tree.
    """
    above = parents.select(
        F.col("tree").alias("__tree"),
        F.col("k").alias("__run"),
        F.col("lo").alias("__from"),
        F.col("hi").alias("__to"),
        F.col("children").alias("__children"),
        F.col("path").alias("__above"),
        F.col("top").alias("__top"),
    )
    inside = (
        (F.col("tree") == F.col("__tree"))
        & (F.floor(F.col("k") / FAN).cast("bigint") == F.col("__run"))
        & (F.col("__from") <= F.col("lo"))
        & (F.col("hi") <= F.col("__to"))
    )
    left = _joined(F.col("__children"), lambda c: c["hi"] <= F.col("lo"))
    right = _joined(F.col("__children"), lambda c: c["lo"] >= F.col("hi"))
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    return nodes.join(above, inside).select(*nodes.columns, F.concat(own, "__above").alias("path"), F.col("__top").alias("top"))


def paths(levels: list[DataFrame], above: DataFrame | None, label: str) -> DataFrame:
    """The leaves of ``grow`` with ``path`` and ``top`` (digest of the top of their tree), from the tops down.

    ``above`` gives the path of a top itself: ``tree``, ``path``.
    """

    def topped(nodes: DataFrame) -> DataFrame:
        tops = nodes.where("n = 1").withColumn("top", F.col("hash"))
        if above is None:
            return tops.withColumn("path", F.array().cast(_PATH)).select(*nodes.columns, "path", "top")
        return tops.join(above.select("tree", "path"), "tree").select(*nodes.columns, "path", "top")

    found = topped(levels[-1])
    for level in reversed(levels[:-1]):
        found = attach(level.where("n > 1"), checkpointed(found, label)).unionByName(topped(level))
    return found


def folded(start: Column, path: Column) -> Column:
    """Root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, run: F.sha2(F.concat(run["left"], acc, run["right"]), 256))


def manifest(
    rows: DataFrame,
    tree_column: str = "source",
    id_column: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the check of what a row holds now.

    ``id``, ``leaf`` (of ``fields``), ``subroot`` (of the row's ``tree_column``), ``root``,
    ``proof_sha256`` (digest of its siblings from the run of the leaf up to the root, left to
    right), ``folded_root`` (from ``tampered`` values of fields, if given, and the same
    siblings) and ``verified``. ``path`` holds the siblings themselves.

    Leaves of a tree ascend by id, null first, equal ids by leaf digest; trees ascend
    bytewise, null first. Null and empty values have digests of their own; repeated rows are
    leaves of their own; an empty table has no rows and no root. Other columns are ignored.
    Texts are read once and never moved: only digests are.
    """
    now = {**{f: F.col(f"`{f}`") for f in fields}, **(tampered or {})}
    leaves = rows.select(
        F.col(f"`{tree_column}`").alias("branch"),
        F.col(f"`{id_column}`").alias("id"),
        leaf_hash([F.col(f"`{f}`") for f in fields]).alias("hash"),
        leaf_hash([now[f] for f in fields]).alias("now"),
    )
    order = [F.col("branch").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("hash").asc()]
    leaves = checkpointed(numbered(leaves, order, "lo", "leaves"), "places")
    # The rows of a branch are neighbours: a branch meets its leaves cell by cell.
    cell = F.shiftright("lo", CELL_BITS)
    parts = leaves.groupBy("branch", cell.alias("cell")).agg(F.min("lo").alias("lo"), F.max("lo").alias("last"))
    branches = parts.groupBy("branch").agg(F.min("lo").alias("lo"), (F.max("last") + 1).alias("hi"))
    branches = checkpointed(
        numbered(branches.select("lo", "hi"), [F.col("lo").asc()], "k", "branches"), "trees"
    )
    trees, longest = branches.agg(F.count("*"), F.max(F.col("hi") - F.col("lo"))).first()
    cells = F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))
    spread = branches.select(
        F.explode(cells).alias("cell"), F.col("lo").alias("first"), F.col("hi").alias("end"), F.col("k").alias("tree")
    )
    inside = (cell == F.col("cell")) & (F.col("first") <= F.col("lo")) & (F.col("lo") < F.col("end"))
    leaves = checkpointed(
        leaves.join(spread, inside).select(
            "tree",
            (F.col("lo") - F.col("first")).alias("k"),
            (F.col("end") - F.col("first")).alias("n"),
            "lo",
            (F.col("lo") + 1).alias("hi"),
            "hash",
            "now",
            "id",
        ),
        "leaves",
    )
    levels, subroots = grow(leaves, longest or 0, "level")
    subroots = checkpointed(subroots, "subroots")
    upper = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("k"), F.lit(trees).cast("bigint").alias("n"), "lo", "hi", "hash"
    )
    upper_levels, top = grow(upper, trees, "upper")
    root = top.first()
    of_tree = paths(upper_levels, None, "upper-path").select(F.col("k").alias("tree"), "path")
    of_tree = checkpointed(of_tree, "subroot-path")
    down = paths(levels, of_tree, "path")
    root = F.lit(root.hash if root else None).cast("string")
    found = down.withColumn("folded_root", folded(F.col("now"), F.col("path")))
    proof = F.array_join(F.transform("path", lambda run: F.concat(run["left"], run["right"])), "")
    return found.select(
        "id",
        F.col("hash").alias("leaf"),
        F.col("top").alias("subroot"),
        root.alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
        "path",
    )


_STEPS = ", ".join(["1"] * 8)
#: Unsigned CRC32 of a decimal id, bit by bit.
CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), {_STEPS}]::BIGINT[], lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    values = [f"CAST({f} AS VARCHAR)" for f in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


def _levels_sql(name: str, depth: int) -> list[str]:
    """Levels of trees: every run of 16 with its nodes in order; a tree of one node stays as it is."""
    out = []
    for n in range(depth):
        out.append(
            f"{name}_run{n} AS (SELECT tree, k // {FAN} AS k, any_value(n) AS n, list(hash ORDER BY k) AS run FROM {name}{n} GROUP BY tree, k // {FAN})"
        )
        out.append(
            f"{name}{n + 1} AS (SELECT tree, k, CAST(ceil(n / {FAN}) AS BIGINT) AS n, "
            f"CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash FROM {name}_run{n})"
        )
    return out


def _climb_sql(name: str, depth: int) -> str:
    """Joins from a leaf ``l`` to its run of every level."""
    return " ".join(
        f"JOIN {name}_run{n} {name}r{n} ON {name}r{n}.tree = l.{name}_tree AND {name}r{n}.k = l.{name}_k // {FAN ** (n + 1)}"
        for n in range(depth)
    )


def _sides_sql(name: str, depth: int) -> tuple[list[str], list[str]]:
    lefts, rights = [], []
    for n in range(depth):
        place = f"(l.{name}_k // {FAN**n}) % {FAN}"
        lefts.append(f"array_to_string({name}r{n}.run[1:{place}], '')")
        rights.append(f"array_to_string({name}r{n}.run[{place} + 2:], '')")
    return lefts, rights


def _oracle(depth: int = 5, upper: int = 3) -> str:
    """The manifest of up to 16^depth documents of a source and 16^upper sources in SQL."""
    lefts, rights = (a + b for a, b in zip(_sides_sql("node", depth), _sides_sql("top", upper)))
    joins = f"{_climb_sql('node', depth)} {_climb_sql('top', upper)}"
    fold, names = [], []
    for n, (left, right) in enumerate(zip(lefts, rights)):
        names.append(f"{left} AS left{n}, {right} AS right{n}")
        fold.append(
            f"f{n + 1} AS (SELECT * EXCLUDE (acc), CASE WHEN left{n} = '' AND right{n} = '' AND alone{n} THEN acc "
            f"ELSE sha256(left{n} || acc || right{n}) END AS acc FROM f{n})"
        )
    alone = [f"noder{n}.n = 1 AS alone{n}" for n in range(depth)] + [f"topr{n}.n = 1 AS alone{depth + n}" for n in range(upper)]
    total = depth + upper
    proof = " || ".join(f"left{n} || right{n}" for n in range(total))
    return f"""
WITH leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {CRC} % 5 = 0 AS bent,
         {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other
  FROM documents
), sources AS (
  SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) AS n FROM leaves GROUP BY source
), placed AS (
  SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), node0 AS (SELECT tree, k, n, leaf AS hash FROM placed),
{", ".join(_levels_sql("node", depth))},
top0 AS (SELECT 0 AS tree, tree AS k, (SELECT count(*) FROM sources) AS n, hash FROM node{depth}),
{", ".join(_levels_sql("top", upper))},
f0 AS (
  SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, {", ".join(names)}, {", ".join(alone)},
         CASE WHEN l.bent THEN l.other ELSE l.leaf END AS acc
  FROM (SELECT *, tree AS node_tree, k AS node_k, 0 AS top_tree, tree AS top_k FROM placed) l
  {joins}
  JOIN node{depth} s ON s.tree = l.tree JOIN top{upper} r ON true
),
{", ".join(fold)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM f{total}
"""


@query("op12_merkle", _oracle())
def merkle(spark, sf_dir):
    """Manifest of all documents; every fifth id is checked after its text was lower-cased."""
    docs = table(spark, sf_dir, "documents")
    bent = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    text = F.when(bent, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    found = manifest(docs, tampered={"text": text})
    return found.withColumnRenamed("id", "doc_id").drop("path")
