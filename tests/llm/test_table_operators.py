"""Re-Pair shards, search, sharding, WARC and vector links against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import collections
import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import MIDDLE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import graph, itq, multi_index, rendezvous, repair, warc

ODD = "doc_id bigint, text string, shard string"
ROWS = [(1, None, "a"), (2, "", None), (5, "a <|endoftext|> b<|endoftext|>", "a"), (3, "one two", "b"), (3, "one two", "b"), (None, "x", None), (4, "ab " * 9000, "c")]


# -- Re-Pair ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [2, 5, 50, 3, 1, 400][seed] + 1, 5000).astype(np.uint32)
    ends = rng.random(5000) < 0.02
    ends[-1] = True
    rules, symbols, last = repair.compress(ids, ends, 1000)
    assert np.array_equal(repair.expand(symbols, rules, 1000), ids) and len(symbols) <= len(ids) - (seed < 5)
    lengths = repair.rule_lengths(rules, 1000)
    assert all(len(repair.expand(np.array([1000 + n], np.uint32), rules, 1000)) == size for n, size in enumerate(lengths[:200]))
    sizes = np.where(symbols >= 1000, lengths[np.maximum(symbols.astype(int) - 1000, 0)] if len(lengths) else 1, 1)
    assert np.array_equal(np.cumsum(sizes)[last] - 1, np.flatnonzero(ends))
    for a in rng.integers(0, 4900, 20):
        assert np.array_equal(repair.expand_range(symbols, rules, lengths, 1000, a, a + 90), ids[a : a + 90])


def test_nothing_to_compress():
    for n in (0, 1, 2):
        rules, symbols, _ = repair.compress(np.arange(n, dtype=np.uint32), np.ones(n, bool), 10)
        assert len(rules) == 0 and len(symbols) == n


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_shards_hold_the_ids_of_the_library(spark, tmp_path, shard_ids):
    path, _ = repair.vocabulary()
    exact = Tokenizer.from_file(path)
    docs = spark.createDataFrame(ROWS, ODD).unionByName(
        spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id < 60").select(F.col("doc_id") + 100, "text", F.lit("s").alias("shard")).toDF("doc_id", "text", "shard")
    )
    out = str(tmp_path / "shards")
    repair.write_shards(docs, out, shard_ids=shard_ids)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text))
    found = sorted(repair.read_documents(spark, out).collect(), key=lambda r: r.start)
    start = 0
    for want, got in zip(rows, found, strict=True):
        ids = exact.encode(want.text or "", add_special_tokens=False).ids + [2]
        assert (got.doc_id, got.start, got.n_tokens, got.ids) == (want.doc_id, start, len(ids), ids)
        start += len(ids)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in repair.read_documents(spark, out, digests=True).collect()}
    assert all(sums[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)


def test_no_documents_no_shards(spark, tmp_path):
    repair.write_shards(spark.createDataFrame([], ODD), str(tmp_path / "none"))
    assert repair.read_documents(spark, str(tmp_path / "none")).count() == 0


# -- rendezvous ------------------------------------------------------------------------------


def _best(key: int, weights) -> int:
    h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    scores = []
    for n, w in enumerate(weights):
        first = xxhash.xxh64(struct.pack("<q", h - (1 << 64) if h >= 1 << 63 else h), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<i", n), seed=first).intdigest() >> 12
        scores.append(-w / np.log((bits + 0.5) / 2**52))
    return int(np.argmax(scores))


def test_shards_of_keys(spark):
    keys = spark.range(3000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 1.0, 4.0]
    rows = rendezvous.place(keys, "k", weights, grown_weight=1.0).collect()
    for r in rows[:300]:
        assert r.shard == _best(r.k, weights) and r.grown_shard == _best(r.k, [*weights, 1.0])
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    share = collections.Counter(r.shard for r in rows)
    assert all(abs(share[n] / 3000 - w / 8) < 0.04 for n, w in enumerate(weights))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.k: r.shard for r in keys.select("k", rendezvous.shard_of("k", weights).alias("shard")).collect()} == {r.k: r.shard for r in rows}


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, ODD)
    rows = rendezvous.place(docs, "doc_id", order_by=("text",)).collect()
    assert len(rows) == len(ROWS) and len({(r.shard, r.slot) for r in rows}) == len(ROWS)
    assert rendezvous.place(docs.limit(0), "doc_id").count() == 0


# -- search ----------------------------------------------------------------------------------


@pytest.mark.parametrize("bits,segments", [(16, 2), (32, None), (63, 4), (12, 3)])
def test_search_is_exact(spark, bits, segments):
    rng = np.random.default_rng(bits)
    codes = rng.integers(0, 1 << bits, 300, dtype=np.int64)
    codes[50:120] = codes[0]
    codes[120:150] = codes[1] ^ (1 << rng.integers(0, bits, 30))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(0, int(codes[0])), (500, None), (None, 3)]
    table = spark.createDataFrame(rows, "vec_id bigint, code bigint")
    found = collections.defaultdict(list)
    for r in multi_index.search(table.where("vec_id % 20 = 0"), table, k=7, bits=bits, segments=segments).collect():
        found[r.query_id].append((r.rank, r.distance, r.vec_id))
    for q in range(0, 300, 20):
        near = sorted((int(codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:7]
        assert sorted(found[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(near)]


def test_search_small_and_empty(spark):
    one = spark.createDataFrame([(1, 5), (2, 5)], "vec_id bigint, code bigint")
    assert [tuple(r) for r in multi_index.search(one.where("vec_id = 1"), one).collect()] == [(1, 1, 2, 0)]
    assert multi_index.search(one.limit(0), one).count() == 0 and multi_index.search(one, one.limit(0)).count() == 0
    odd = spark.createDataFrame([([1.0, None, -3.0, float("nan")],), (None,)], "v array<double>")
    assert [r[0] for r in odd.select(multi_index.folded_code("v", 2)).collect()] == [0, None]


# -- vectors ---------------------------------------------------------------------------------


def _links(x: np.ndarray):
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=len(x))) for i in range(len(x))])
        if np.array_equal(new, label):
            return near.sum(axis=1), label
        label = new


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    for n, noise in ((0, 0.02), (60, 0.3), (120, 0.45)):
        x[n : n + 50] = x[n] + rng.normal(size=(50, 24)) * noise
    x[200:220] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(f) for f in v * (i % 7 + 1)]) for i, v in enumerate(x)]
    found = {r.id: r for r in itq.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    links, label = _links(x)
    got = np.array([found[i].n_links for i in range(400)])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
    assert np.mean([found[i].component_id == label[i] for i in range(400)]) > 0.95


def test_links_of_a_follower_whose_leader_left(spark):
    # In a plane: M, L, K at 12 degrees each, B 20 beyond K. L hangs below M, so K is alone in L's core.
    rng = np.random.default_rng(6)
    x = []
    for _ in range(60):
        plane, _ = np.linalg.qr(rng.normal(size=(64, 2)))
        x += [plane @ [np.cos(t), np.sin(t)] for t in np.radians([0, 12, 24, 44])]
    data = itq.unit(pa.array([v.tolist() for v in x]))
    unit = np.stack([np.frombuffer(d) for d in data])
    keys = [hashlib.blake2b(d, digest_size=16).digest() for d in data]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {r.id: r for r in itq.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    links, _ = _links(unit)
    got = np.array([found[i].n_links for i in range(len(x))])
    left = [i + 2 for i in range(0, len(x), 4) if keys[i] < keys[i + 1] < keys[i + 2]]
    assert len(left) >= 5 and (links[left] == 3).all() and (got <= links).all()
    assert np.mean(got[left] == 3) >= 0.8


@pytest.mark.parametrize("shift", [0.0, 0.8, 1.5])
def test_links_of_vectors_off_centre(spark, shift):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in range(0, 900, 3):
        # Pairs about the threshold, and a little beyond.
        x[n + 1] = x[n] + rng.normal(size=48) * rng.choice([0.05, 0.075, 0.085])
    mean = rng.normal(size=48)
    x += shift * mean / np.linalg.norm(mean)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {r.id: r.n_links for r in itq.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    links, _ = _links(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = np.array([found[i] for i in range(len(x))])
    assert links.sum() > 250 and (got <= links).all() and got.sum() >= 0.95 * links.sum()


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(9)
    rows = []
    for size in (1, 2, 3, 3, 3, 70, 200):
        base = rng.normal(size=size)
        rows += [(len(rows) + n, (base * (n + 1)).tolist()) for n in range(2)] + [(len(rows) + 2, (-base).tolist())]
    found = {r.id: r for r in itq.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lengths=2).collect()}
    for i, a in rows:
        same = [j for j, b in rows if len(a) == len(b) and j != i and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9]
        assert found[i].n_links == len(same) and found[i].component_id == min([i, *same])


def test_tables_grow_with_the_vectors():
    for vectors in (0, 1, 100, 10**5, 10**9):
        width, segments, codes = itq.tables_for(vectors, 64, 0.9, 0.97)
        agree = (1 - np.arccos(0.9) / np.pi) ** width
        assert width * segments <= 64 and 1 - (1 - agree) ** (segments * codes) >= 0.97
        assert width == 8 or vectors / 2**width <= 64


def test_vectors_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
        (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [1e300, 1e300]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("key", F.lit("k"))
    found = sorted(((r.id, r.n_links, r.component_id) for r in itq.linked(frame).collect()), key=str)
    assert len(found) == len(rows)
    assert found.count((2, 2, 1)) == 2 and (1, 2, 1) in found and (None, 0, None) in found
    assert all((n, 0, n) in found for n in (3, 4, 5, 6, 7, 8, 9, 10))
    assert itq.linked(frame.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    linked = {i for a, b in pairs if a is not None and a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}


# -- WARC ------------------------------------------------------------------------------------


def test_pages_round_trip(spark, tmp_path):
    warc.register(spark)
    big = "<p>é</p>" * 300
    pages = spark.createDataFrame(
        [(1, "http://a/1", big, "x"), (2, "http://a/2", big, "x"), (3, None, None, "x"), (4, "http://b\n/4", "small", "x"),
         (5, "http://b/5", "small", "x"), (None, "http://c", big, "x"), (2, "http://a/2", big, "x")],
        "page_id bigint, url string, html string, record_type string",
    )
    path = str(tmp_path / "w")
    warc.page_records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    rows = sorted((r.record_id, r.record_type, r.refers_to, r.payload_length) for r in back.collect())
    size = len(big.encode())
    assert rows.count(("<urn:page:2>", "response", None, size)) == 2
    assert ("<urn:page:1>", "revisit", "<urn:page:2>", size) in rows and ("<urn:page:null>", "revisit", "<urn:page:2>", size) in rows
    assert ("<urn:page:3>", "response", None, 0) in rows and ("<urn:page:4>", "response", None, 5) in rows and len(rows) == 7
    wanted = back.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a"))
    assert "PushedFilters" in wanted._jdf.queryExecution().toString() or wanted.count() == 2
    assert {bytes(r.payload).decode() for r in wanted.collect()} == {big}
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.count() == 7 and heads.where("payload is not null").count() == 0
    none = str(tmp_path / "none")
    warc.page_records(pages.limit(0)).write.format("warc").mode("append").save(none)
    assert spark.read.format("warc").load(none).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Plain members without a length, uncompressed files, and payloads that look like records."""
    warc.register(spark)
    rows = [
        {"record_type": "response", "record_id": "<urn:page:%d>" % n, "target_uri": "http://h/%d" % n, "payload": (b"WARC/1.1\r\n\r\n%d" % n) * (n * 400 + 1)}
        for n in range(6)
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes(r)) for r in rows[:3]))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.record_bytes(r) for r in rows[3:]))
    back = spark.read.format("warc").load(str(tmp_path))
    assert {r.record_id: bytes(r.payload) for r in back.collect()} == {r["record_id"]: r["payload"] for r in rows}
    some = back.where(F.col("target_uri").isin("http://h/1", "http://h/4")).collect()
    assert {r.record_id for r in some} == {"<urn:page:1>", "<urn:page:4>"}


def test_unwanted_payloads_are_not_inflated(tmp_path):
    data = b"".join(warc.member(warc.record_bytes({"record_type": t, "payload": b"x" * 500_000})) for t in ("request", "response"))
    (tmp_path / "c.warc.gz").write_bytes(data)
    reader = warc.WarcReader(str(tmp_path), 1 << 20, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == []
    (batch,) = [b for part in reader.partitions() for b in reader.read(part)]
    assert batch.column("record_type").to_pylist() == ["response"] and len(batch.column("payload")[0].as_py()) == 500_000


def test_words_known_before_a_full_table_is_cleared():
    path, pattern = repair.vocabulary()
    encoder = repair.WordEncoder(path, pattern, most=3)
    for text in ("alpha beta", "alpha gamma delta epsilon", "beta alpha"):
        found = np.frombuffer(encoder.encode([text])[0], np.uint32)
        assert found.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_by_the_model_alone():
    from types import SimpleNamespace

    path, pattern = repair.vocabulary()
    encoder = repair.WordEncoder(path, pattern)
    texts = ["", " ", "a  b\n\n c ", "It's we'll 12 345x", "Èonai, naïve ᠎ 日本語 🙂\x00\x7f\xad", " lead  \t tail\r\n", "ﬁ ſ's é é"]
    library = [np.array(e.ids, np.uint32).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.tokenizer = SimpleNamespace(model=encoder.tokenizer.model)
    assert encoder.encode(texts) == library
    other = repair.WordEncoder(path, pattern + "|$^")
    assert not other.plain and other.encode(texts) == library
