"""Merkle manifests, conversation tries and SpotSigs against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, prefix_trie, ranks, spot_sigs


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- places ----------------------------------------------------------------------------------


def test_numbered(spark):
    rows = [(None if n % 50 == 0 else n % 40, n % 3) for n in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    found = ranks.numbered(df, [F.col("a").desc_nulls_last(), F.col("b").asc()]).collect()
    assert sorted(r["at"] for r in found) == list(range(500))
    ordered = [(r.a, r.b) for r in sorted(found, key=lambda r: r["at"])]
    assert ordered == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert ranks.numbered(df.limit(0), [F.col("a").asc()]).count() == 0


# -- Merkle ----------------------------------------------------------------------------------


def leaf_of(row) -> str:
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(parts))


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[n : n + 16])) for n in range(0, len(below), 16)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        start = at // 16 * 16
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 16])))
        at //= 16
    return out


def expected_manifest(rows: list[tuple]) -> dict:
    """By ``(doc_id, leaf)``: subroot, root, proof and the root folded from the changed row."""
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, ordered = [], {}
    for source in sources:
        ordered[source] = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(levels_of([leaf_of(r) for r in ordered[source]]))
    upper = levels_of([t[-1][0] for t in trees])
    out = {}
    for n, source in enumerate(sources):
        for at, row in enumerate(ordered[source]):
            path = siblings(trees[n], at) + siblings(upper, n)
            bent = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4] if row[4] is None or not bent else re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
            now = leaf_of((*row[:4], text))
            for left, right in path:
                now = sha(left + now + right)
            proof = sha("".join(a + b for a, b in path))
            out.setdefault((row[0], leaf_of(row)), []).append((trees[n][-1][0], upper[-1][0], proof, now, now == upper[-1][0]))
    return out


DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def check_manifest(spark, rows: list[tuple]) -> None:
    docs = spark.createDataFrame(rows, DOC)
    # Columns whose names the operator uses itself.
    docs = docs.withColumns({c: F.lit("x") for c in ("k", "n", "lo", "hi", "hash", "tree", "path", "top", "now")})
    bent = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    text = F.when(bent, F.translate("text", merkle._UPPER, merkle._LOWER)).otherwise(F.col("text"))
    found: dict = {}
    for r in merkle.manifest(docs, tampered={"text": text}).collect():
        found.setdefault((r.id, r.leaf), []).append((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    want = expected_manifest(rows)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_of_many_shapes(spark):
    rows = []
    for source, count in {"a": 1, "b": 16, "c": 17, "é": 257, "Z": 300, None: 33, "": 2}.items():
        for _ in range(count):
            n = len(rows)
            text = [None, "", "ABC def ÄÖ", "lower", "X" * 5000, f"Text {n}"][n % 6]
            rows.append((n * 7 % 1009, source, None if n % 9 == 0 else "en", None if n % 11 == 0 else n, text))
    check_manifest(spark, rows)


def test_manifest_of_odd_rows(spark):
    check_manifest(spark, [(5, "s", "en", 1, "A")])
    same = (10, "s", "en", 1, "Aa")
    check_manifest(spark, [same, same, (None, "s", "en", 1, "B"), (None, None, None, None, None), (3, None, "", 0, "")])
    empty = merkle.manifest(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and "verified" in empty.columns


def test_many_sources_make_an_upper_tree(spark):
    check_manifest(spark, [(n, f"host{n % 290}", "en", 1, f"T{n}") for n in range(600)])


def test_a_changed_row_is_found(spark):
    rows = [(n, "s", "en", n, f"text {n}") for n in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    changed = F.when(F.col("doc_id") == 17, "other").otherwise(F.col("text"))
    found = merkle.manifest(docs, tampered={"text": changed})
    assert [r.id for r in found.where("NOT verified").collect()] == [17]
    assert merkle.manifest(docs).where("NOT verified").count() == 0


# -- trie ------------------------------------------------------------------------------------


def expected_trie(paths: dict[int, list[tuple]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for conv, turns in paths.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    children: dict[tuple, list[tuple]] = {node: [] for node in members}
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node in members:
        under = [u for u in members if u[: len(node)] == node]
        ends = sorted(c for c in members[node] if len(paths[c]) == len(node))
        saved = sum((len(members[u]) - 1) * (len((u[-1][1] or "").encode()) if u else 0) for u in under)
        leaves = sum(not children[u] for u in under)
        parent = min(members[node[:-1]]) if node else None
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, sha(",".join(map(str, ends)))))
    return out


TURN = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(paths: dict[int, list[tuple]]) -> list[tuple]:
    return [(c, n, role, text) for c, turns in paths.items() for n, (role, text) in enumerate(turns)]


def check_trie(spark, paths: dict[int, list[tuple]]) -> None:
    rows = spark.createDataFrame(turns_of(paths), TURN).withColumns({c: F.lit(1) for c in ("at", "key", "size", "shard", "path")})
    found = prefix_trie.prefix_trie(prefix_trie.sequences(rows)).select(*COLUMNS).collect()
    normal = {c: [(r or "", t or "") for r, t in turns] for c, turns in paths.items()}
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == expected_trie(normal)


@pytest.fixture
def tiny_shards(monkeypatch):
    monkeypatch.setattr(prefix_trie, "_FEW", 5)


@pytest.mark.parametrize("seed", range(4))
def test_trie_over_many_shards(spark, tiny_shards, seed):
    pick = random.Random(seed)
    texts = ["a", "b", "ä", "", None, "long " * 50]
    paths = {
        pick.randrange(-500, 10**6): [(pick.choice(["user", "assistant", None]), pick.choice(texts)) for _ in range(pick.randrange(1, 5))]
        for _ in range(150)
    }
    # Equal conversations in numbers that no shard holds alone, and one that goes on far beyond the others.
    paths |= {2_000_000 + n: [("user", "same"), ("assistant", "same")] for n in range(60)}
    paths[3_000_000] = [("user", "same"), ("assistant", "same")] + [("user", f"t{n}") for n in range(300)]
    paths[3_000_001] = paths[3_000_000][:250]
    check_trie(spark, paths)


def test_trie_of_one_shard_and_of_nothing(spark):
    check_trie(spark, {1: [("user", "x")], 2: [("user", "x"), ("a", "y")], 5: [("user", "z")]})
    none = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame([], TURN)))
    assert none.count() == 0 and none.columns == COLUMNS


def test_splitters_are_thinned_to_their_bound(spark, tiny_shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 400)
    check_trie(spark, {n: [("user", str(n % 7)), ("a", str(n))] for n in range(200)})


def test_rebuilt_conversations(spark, tiny_shards):
    pick = random.Random(9)
    paths = {c: [("user", f"{c}-{n}") for n in range(pick.randrange(1, 13))] for c in (*range(0, 40), 45, 51, 52, 1003, 1004)}
    paths[7] = [("user", None)] * 3
    del paths[10], paths[20]
    want = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = paths.get(c - c % 5, [])[:h] + own[h:]
    rows = spark.createDataFrame(turns_of(paths), TURN)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(rows))).select(*COLUMNS).collect()
    normal = {c: [(r or "", t or "") for r, t in turns] for c, turns in want.items()}
    assert any(not turns for turns in normal.values()) and {tuple(r) for r in found} == expected_trie(normal)


def test_order_of_turns(spark):
    rows = [(1, 2, "u", "c"), (1, None, "u", "a"), (1, 1, "u", "b"), (None, 1, "u", "lost")]
    found = prefix_trie.sequences(spark.createDataFrame(rows, TURN)).collect()
    keys = [hashlib.sha256(f"1:u{t}".encode()).digest()[:16] for t in "abc"]
    assert len(found) == 1 and [bytes(k) for k in found[0]["keys"]] == keys


# -- SpotSigs --------------------------------------------------------------------------------


def spots(text: str | None) -> list[str]:
    known = {"^", *spot_sigs.ANCHORS}
    lines = "^" + (text or "").lower().replace("^", " ").replace("\n", "^")
    found = [w for w in re.findall(r"\^|[^\W_]+", lines)]
    out = set()
    for n, word in enumerate(found):
        chain = [w for w in found[n + 1 :] if w not in known][: spot_sigs.CHAIN]
        if word in known and len(chain) == spot_sigs.CHAIN:
            out.add(" ".join([word, *chain]))
    bare = [w for w in found if w != "^"]
    return sorted(out, key=str.encode) if out else ["=" + (" ".join(found) if bare else text or "")]


TEXTS = [
    None, "", " ", "...", "one two", "The cat sat on the mat and the dog ran to a big house in the wood of green trees",
    "^ carets ^ count for nothing here, only lines do\n\nsecond line of the text with more words in it\n",
    "Der Hund läuft über die grüne Wiese und bellt den Mann an", "a a a a a a", "x " * 3000 + "the end of it all is near now",
    "the " + " ".join(f"word{n}" for n in range(2000)), "tab\tthe\tquick\tbrown\tfox\tjumps",
]


def test_signatures(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string")
    found = {r.n: r.s for r in df.select("n", spot_sigs.signatures(F.col("t")).alias("s")).collect()}
    assert found == {n: spots(t) for n, t in enumerate(TEXTS)}


def test_edits(spark):
    rows = [(n * 3, t) for n, t in enumerate(TEXTS)] + [(None, "no id but the words of it"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("key", "id", "at", "next", "n_chars")})
    found = spot_sigs.edits(docs).collect()
    order = sorted(set(rows) - {(3, "")}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sum(r.id == 3 for r in found) == 2 and len(found) == len(rows)
    for n, (doc_id, text) in enumerate(order):
        own, other = text or "", order[(n + 1) % len(order)][1] or ""
        if doc_id == 3:
            continue
        row = next(r for r in found if r.id == doc_id)
        k = len(own) // 3
        edited = own[: len(own) - k] + other[:k]
        a, b, c = set(spots(own)), set(spots(edited)), set(spots(other))
        assert row.edited_sha256 == sha(edited) and row.n_chars == len(own)
        assert row.fingerprint == sha("\n".join(spots(own))) and row.edited_fingerprint == sha("\n".join(spots(edited)))
        assert row.near_edited == len(a & b) / len(a | b) and row.near_next == len(a & c) / len(a | c)
    assert spot_sigs.edits(docs.limit(0)).count() == 0


def test_matches_equal_brute_force(spark):
    pick = random.Random(4)
    words = [f"w{n}" for n in range(60)]
    bases = [[pick.choice([*words, "the", "of", "in"]) for _ in range(pick.randrange(20, 120))] for _ in range(12)]
    rows = []
    for n in range(150):
        text = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 2, 6])):
            text[pick.randrange(len(text))] = pick.choice(words)
        rows.append((n, " ".join(text)))
    rows += [(200, None), (201, ""), (202, ""), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = docs.where("doc_id % 20 = 0 OR doc_id > 190")
    found = sorted((r.query_id, -1 if r.id is None else r.id, round(r.similarity, 9)) for r in spot_sigs.matches(asked, docs).collect())
    want = []
    for (q, a), (d, b) in itertools.product([r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] > 190)], rows):
        if a is not None and b is not None:
            x, y = set(spots(a)), set(spots(b))
            if len(x & y) / len(x | y) >= 0.8:
                want.append((q, -1 if d is None else d, round(len(x & y) / len(x | y), 9)))
    assert found == sorted(want) and len(want) > 40


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_length_partitions(spark, threshold):
    sizes = spark.range(1, 400).select("id", spot_sigs.length_partition(F.col("id"), threshold).alias("p"))
    part = {r.id: r.p for r in sizes.collect()}
    for a, b in itertools.combinations(part, 2):
        assert a / b < threshold or part[b] - part[a] <= 1
