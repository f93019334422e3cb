"""Near duplicates by Order MinHash (published by Marcais, DeBlasio, Pandey and Kingsford).

Every text gives ``sketches`` sketches. A sketch takes the ``minima`` smallest hashes among the
occurrence-labelled runs of ``k`` words and keeps them in text order, so two texts share it when
they agree on runs *and* on their order. Texts that share a sketch are candidates, and a banded
alignment of their runs decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.registry import query, table
from millrace.llm.words import blocks, mix, release, shingles, word_hashes
from millrace.session import checkpointed

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SLOT_BITS = 20


def sketch(runs: np.ndarray, begin: np.ndarray, sketches: int, minima: int) -> np.ndarray:
    """One row of ``sketches`` hashes for every text; texts without runs get zeros."""
    out = np.zeros((len(begin) - 1, sketches), np.uint64)
    full = np.flatnonzero(np.diff(begin) > 0)
    if not len(full):
        return out
    starts, counts = begin[full], np.diff(begin)[full]
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    text = np.repeat(np.arange(len(full)), counts)
    for i, factor in enumerate(factors):
        x = runs * factor
        places = np.full((len(full), minima), len(runs), np.int64)
        for j in range(minima):
            low = np.minimum.reduceat(x, starts)
            hit = np.flatnonzero((x == low[text]) & (x != _TOP))
            owners, firsts = np.unique(text[hit], return_index=True)
            places[owners, j] = hit[firsts]
            x[hit[firsts]] = _TOP
        places.sort(axis=1)
        padded = np.append(runs, np.uint64(0))
        h = np.full(len(full), mix(np.uint64([i + 1]))[0], np.uint64)
        for j in range(minima):
            h = mix(h ^ padded[places[:, j]])
        out[full, i] = h
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Share of runs that a banded alignment of two texts matches: L / (|a| + |b| - L).

    L is the longest common subsequence of labelled runs. A share of ``threshold`` leaves at
    most (|a| + |b|) (1 - threshold) / (1 + threshold) runs unmatched, so no matched pair can
    lie further apart than that: the band. Runs are unique within a text, so the subsequence
    is the longest rising one among the matched places. Below the threshold the value may
    be an upper bound.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    order = np.argsort(b)
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    mine = np.flatnonzero(ranked[at] == a)
    theirs = order[at[mine]]
    band = total * (1 - threshold) / (1 + threshold)
    theirs = theirs[np.abs(mine - theirs) <= band]
    length = len(theirs)
    if length / (total - length) < threshold or (np.diff(theirs) > 0).all():
        return length / (total - length)
    tails: list[int] = []
    for j in theirs.tolist():
        spot = bisect_left(tails, j)
        if spot == len(tails):
            tails.append(j)
        else:
            tails[spot] = j
    return len(tails) / (total - len(tails))


def _runs(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for start, _, data, offsets in blocks(column):
        yield (start, *shingles(*word_hashes(data, offsets), k))


def _sketch_batches(k: int, sketches: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, runs, begin in _runs(batch.column(1), k):
                found = sketch(runs, begin, sketches, minima).view(np.int64)
                edges = pa.array(np.arange(len(found) + 1, dtype=np.int32) * sketches)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(found)),
                        pa.ListArray.from_arrays(edges, pa.array(found.ravel())),
                        pa.array(np.diff(begin), pa.int64()),
                    ],
                    names=["key", "marks", "runs"],
                )
        release()

    return run


def _slots(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _count_batches(k: int):
    """How many runs fall into each slot, summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        for batch in batches:
            for _, runs, _ in _runs(batch.column("text"), k):
                total += np.bincount(_slots(runs), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    return run


def rarest(
    runs: np.ndarray, begin: np.ndarray, common: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and place of the rarest runs of every text, so many that two similar texts share one.

    Texts at the threshold share ``threshold`` of the runs of the longer one at least, so of
    either text no more than the others can be missing from the other. Runs are ranked by
    ``common``, the count of their slot, and then by hash: one order for all texts.
    """
    size = np.diff(begin)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((runs, common[_slots(runs)], text))
    most = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    place = np.arange(len(runs)) - begin[text]
    first = place < most[text]
    return text[order[first]], runs[order[first]], place[first]


def _rare_batches(k: int, threshold: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, runs, begin in _runs(batch.column("text"), k):
                owner, found, place = rarest(runs, begin, common.value, threshold)
                key = batch.column("key").take(pa.array(owner + start))
                size = np.diff(begin)[owner]
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(found.view(np.int64)), pa.array(place), pa.array(size)], names=["key", "h", "place", "runs"]
                )

    return run


def _align_batches(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [r[b : e] for _, r, at in _runs(batch.column("text"), k) for b, e in zip(at[:-1], at[1:])]
            right = [r[b : e] for _, r, at in _runs(batch.column("other"), k) for b, e in zip(at[:-1], at[1:])]
            same = [aligned(x, y, threshold) >= threshold for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("pivot"), pa.array(same, pa.bool_())],
                names=["key", "pivot", "same"],
            )
        release()

    return run


def _meeting(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``key``, ``pivot`` of texts of different ``root`` that may still be similar.

    ``own`` has the rarest runs ``h`` of texts with their ``place`` among the text's runs by
    rarity and its number of ``runs``. The first run that two texts share leaves them at most
    the rest of either in common, so it must come early enough in both for the threshold. A
    run too late for the shortest text that has it is left out before texts meet. Members of
    the largest root of a run meet only texts of other roots, so the work does not grow with
    the square of a group of joined copies.
    """
    share = threshold / (1 + threshold)
    left = F.col("runs") - F.col("place")
    of_root = own.groupBy("h", "root").agg(F.count("*").alias("n"), F.min("runs").alias("low"))
    of_run = of_root.groupBy("h").agg(
        F.max(F.struct("n", "root"))["root"].alias("top"), F.min("low").alias("low"), F.count("*").alias("roots")
    )
    fits = left >= (F.col("runs") + F.col("low")) * share - 1e-6
    side = own.join(of_run.where("roots > 1"), "h").where(fits).select("h", "key", "root", "top", "runs", left.alias("left"))
    side = checkpointed(side, "side")
    strays = side.where("root != top").select(
        "h", F.col("key").alias("stray"), F.col("root").alias("root_stray"), F.col("runs").alias("runs_stray"), F.col("left").alias("left_stray")
    )
    once = (F.col("root") == F.col("top")) | (F.col("stray") < F.col("key"))
    enough = F.least("left", "left_stray") >= (F.col("runs") + F.col("runs_stray")) * share - 1e-6
    met = strays.join(side, "h").where((F.col("root") != F.col("root_stray")) & once & enough)
    return met.select(F.greatest("key", "stray").alias("key"), F.least("key", "stray").alias("pivot")).distinct()


def _split(own: DataFrame) -> DataFrame:
    """Buckets of several roots: the largest root and its smallest key."""
    of_root = own.groupBy("h", "root").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    of_bucket = of_root.groupBy("h").agg(F.max(F.struct("n", "root", "first")).alias("top"), F.count("*").alias("roots"))
    return of_bucket.where("roots > 1").select("h", F.col("top.root").alias("top"), F.col("top.first").alias("pivot"))


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    sketches: int = 16,
    minima: int = 2,
    agree: int = 3,
) -> DataFrame:
    """``id``, ``key`` (MD5 of the text), ``class_key``, ``class_id`` (smallest id), ``n_texts``.

    One row per input row. Equal texts are one node from the start. A pair of texts is likely
    if it agrees on ``agree`` of all sketches (a pair at the threshold of 0.8 falls short of
    three once in 30,000) and its lengths allow the threshold. Links join to classes.

    Texts that share a sketch first meet the most typical of them, which lies in the largest
    buckets: each the most typical it knows, then those of other classes, while one text of each
    class so far meets one of the largest class of its bucket; so a large group of copies costs
    about one alignment per text. What shares ``agree`` sketches with other classes after that meets them
    by its rarest runs: two texts at the threshold must have one of these in common, early
    enough in both, so every likely pair that the links have not joined is aligned, linked
    texts included.

    Null texts and texts without words link with nothing, null ones not even with each other:
    their ``key`` is null and their class is their own id. Texts differ by every byte; runs
    ignore letter case. Null ids count only when a class has no other; repeated rows share a
    class. An empty table gives an empty table, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn(
        "key", F.when(F.col("text").rlike(r"[^\x00-\x20]"), F.unhex(F.md5("text")))
    )
    worded = rows.where(F.col("key").isNotNull())
    marked = checkpointed(
        worded.select("key", F.lower("text").alias("text"))
        .mapInArrow(_sketch_batches(k, sketches, minima), "key binary, marks array<bigint>, runs bigint"),
        "sketches",
    )
    marks = checkpointed(marked.groupBy("key").agg(F.first("marks").alias("marks"), F.first("runs").alias("runs")), "marks")
    members = marks.select("key", F.explode(F.array_distinct("marks")).alias("h"))
    sizes = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(members.join(sizes, "h"), "sized")
    # Whatever may pass shares at least so many sketches with others. A text in many large
    # buckets is typical of its group: most of the group is near it.
    wanted = checkpointed(
        members.groupBy("key").agg(F.collect_list("h").alias("marks"), F.sum("n").alias("weight"))
        .where(F.size("marks") >= agree), "wanted",
    )
    members = wanted.select("key", F.explode("marks").alias("h"), "weight")
    stars = members.groupBy("h").agg(F.max(F.struct("weight", "key")).alias("star"))
    members = members.select("h", "key").join(stars, "h").select("h", "key", F.col("star.key").alias("pivot"), F.col("star.weight").alias("weight"))
    members = checkpointed(members, "members")
    texts = checkpointed(
        worded.select("key", F.lower("text").alias("text")).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "texts"
    )

    def likely(pairs: DataFrame) -> DataFrame:
        theirs = marks.select(F.col("key").alias("pivot"), F.col("marks").alias("theirs"), F.col("runs").alias("length"))
        shared = F.aggregate(
            F.zip_with("marks", "theirs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x
        )
        fits = F.least("runs", "length") >= F.greatest("runs", "length") * threshold - 1e-9
        found = pairs.join(marks, "key").join(theirs, "pivot").where(fits & (shared >= agree))
        return checkpointed(found.select(*pairs.columns), "pairs")

    def judge(pairs: DataFrame) -> DataFrame:
        other = texts.select(F.col("key").alias("pivot"), F.col("text").alias("other"))
        found = pairs.select("key", "pivot").join(texts, "key").join(other, "pivot").select("key", "pivot", "text", "other")
        found = found.mapInArrow(_align_batches(k, threshold), "key binary, pivot binary, same boolean")
        return checkpointed(found.where("same").select("key", "pivot"), "links")

    def rooted(side: DataFrame, *columns: str) -> DataFrame:
        known = labels.select("key", F.col("root").alias("__root"))
        return side.join(known, "key", "left").select(*columns, "key", F.coalesce("__root", "key").alias("root"))

    def joined(links: DataFrame) -> DataFrame:
        below = labels.where("key != root").select("key", F.col("root").alias("pivot"))
        found = components(below.unionByName(links), "key", "pivot")
        return checkpointed(found.select(F.col("node").alias("key"), F.col("component").alias("root")), "labels")

    pairs = likely(members.where("key != pivot").select("key", "pivot", "weight").distinct())
    links = judge(pairs.groupBy("key").agg(F.max(F.struct("weight", "pivot"))["pivot"].alias("pivot")))
    # Every text hangs below one more typical: two hops reach most roots.
    up = links.select(F.col("key").alias("pivot"), F.col("pivot").alias("above"))
    hop = links.join(up, "pivot", "left").select("key", F.coalesce("above", "pivot").alias("root"))
    hop = checkpointed(hop, "hop")
    again = hop.select(F.col("key").alias("root"), F.col("root").alias("above"))
    labels = checkpointed(
        hop.join(again, "root", "left").select("key", F.coalesce("above", "root").alias("root")), "labels"
    )
    of_pivot = labels.select(F.col("key").alias("pivot"), F.col("root").alias("root_pivot"))
    open_pairs = (
        pairs.join(labels, "key", "left").join(of_pivot, "pivot", "left")
        .where(F.coalesce("root", "key") != F.coalesce("root_pivot", "pivot")).select("key", "pivot")
    )
    members = members.select("h", "key")
    own = checkpointed(rooted(members, "h"), "own")
    of_root = own.groupBy("h", "root").agg(F.min("key").alias("key"))
    firsts = of_root.join(_split(own), "h").where("root != top").select("key", "pivot")
    met = open_pairs.unionByName(firsts)
    new = judge(likely(met.select(F.greatest("key", "pivot").alias("key"), F.least("key", "pivot").alias("pivot")).distinct()))
    labels = joined(new)
    own = checkpointed(rooted(members, "h"), "own")
    # A likely pair that is still apart shares so many buckets of several roots.
    apart = own.join(_split(own).select("h"), "h", "left_semi")
    apart = apart.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select("key")
    crowd = checkpointed(texts.join(apart, "key", "left_semi"), "crowd")
    counts = crowd.mapInArrow(_count_batches(k), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << _SLOT_BITS, np.int64)
    common[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(common)
    rare = crowd.mapInArrow(_rare_batches(k, threshold, shared), "key binary, h bigint, place bigint, runs bigint")
    rare = checkpointed(rooted(rare, "h", "place", "runs"), "rare")
    shared.destroy()
    pairs = _meeting(rare, threshold)
    new = judge(likely(pairs))
    if not new.isEmpty():
        labels = joined(new)
    groups = labels.select(F.col("key").alias("node"), F.col("root").alias("component"))
    # Narrow from here on: ids and keys only.
    narrow = rows.select("id", "key").join(
        groups.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("component", F.coalesce("component", "key"))
    narrow = checkpointed(narrow, "narrow")
    least = checkpointed(
        narrow.where("component is not null")
        .groupBy("component", "key").agg(F.min("id").alias("class_id"))
        .groupBy("component").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n_texts")),
        "least",
    )
    alone = narrow.where("component is null").select(
        "id", "key", F.col("component").alias("class_key"), F.col("id").alias("class_id"),
        F.lit(1).cast("bigint").alias("n_texts"),
    )
    found = narrow.where("component is not null").join(least, "component")
    return found.select(
        "id", "key", F.col("component").alias("class_key"), "class_id", "n_texts"
    ).unionByName(alone)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id.

    Rows without words stay, all of them. Of repeated rows with the same id and text one stays.
    """
    found = classes(docs, id_column, text_column, **options)
    kept = checkpointed(
        found.where(F.col("key").isNotNull() & F.col("id").eqNullSafe(F.col("class_id")))
        .groupBy("class_key")
        .agg(F.min(F.struct("key", "id")).alias("__best"), F.count("*").alias("__rows"))
        .select(F.col("__best.key").alias("__key"), F.col("__best.id").alias("__id"), "__rows"),
        "kept",
    )
    # Whole rows travel as one value, so no column of theirs can clash with a name used here.
    text = F.col(f"`{text_column}`")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.unhex(F.md5(text)).alias("__own"),
        F.col(f"`{id_column}`").alias("__mine"), F.coalesce(text.rlike(r"[^\x00-\x20]"), F.lit(False)).alias("__worded"),
    )
    joined = named.where("__worded").join(kept, (F.col("__own") == F.col("__key")) & F.col("__mine").eqNullSafe(F.col("__id")))
    single = joined.where("__rows = 1").select("__row")
    repeated = joined.where("__rows > 1").dropDuplicates(["__own", "__mine"]).select("__row")
    bare = named.where("NOT __worded").select("__row")
    return single.unionByName(repeated).unionByName(bare).select("__row.*")


@query("op9_order_minhash")
def order_minhash(spark, sf_dir):
    """One row per document: its class of near copies and whether it is the one that stays."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "class_id", "n_texts", (F.col("id") == F.col("class_id")).alias("kept")
    )
