"""Sliced windows give the same as a plain pass over each key, whatever the slice width."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.ordered import fill, next_row, running_sum
from millrace.operators.corpus import turns_to_pairs
from millrace.operators.metrics import nearest_step

SCHEMA = "key string, seq bigint, value bigint"


def made(seed: int) -> list[tuple]:
    """Half of the rows share one key; sequence numbers have gaps and may be negative."""
    rnd = random.Random(seed)
    seqs = rnd.sample(range(-200, 800), 300)
    return [
        (rnd.choice(["hot", "hot", "a", "b"]), s, rnd.choice([None, None, rnd.randint(0, 9)]))
        for s in seqs
    ]


def by_key(rows):
    groups: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_running_sum(spark, bits):
    rows = made(1)
    expected = {}
    for key, group in by_key(rows).items():
        total = 0
        for _, seq, value in group:
            total += value or 0
            expected[key, seq] = total
    df = spark.createDataFrame(rows, SCHEMA)
    value = F.coalesce("value", F.lit(0))
    got = running_sum(df, ["key"], "seq", value, "total", bits).collect()
    assert {(r.key, r.seq): r.total for r in got} == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_fill(spark, bits):
    rows = made(2)
    expected = {}
    for key, group in by_key(rows).items():
        for i, (_, seq, _) in enumerate(group):
            before = [(s, v) for _, s, v in group[: i + 1] if v is not None]
            after = [(s, v) for _, s, v in group[i:] if v is not None]
            expected[key, seq] = (before[-1] if before else None, after[0] if after else None)
    df = spark.createDataFrame(rows, SCHEMA)
    got = fill(df, ["key"], "seq", "value", "before", "after", bits).collect()
    pairs = {(r.key, r.seq): tuple(tuple(s) if s else None for s in (r.before, r.after)) for r in got}
    assert pairs == expected
    one = fill(df, ["key"], "seq", "value", after="next", bits=bits).collect()
    assert {(r.key, r.seq): tuple(r.next) if r.next else None for r in one} == {
        k: v[1] for k, v in expected.items()
    }


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_next_row(spark, bits):
    rows = made(3)
    expected = {}
    for key, group in by_key(rows).items():
        for this, following in zip(group, [*group[1:], None], strict=True):
            expected[key, this[1]] = following[1:] if following else None
    df = spark.createDataFrame(rows, SCHEMA)
    got = next_row(df, ["key"], "seq", ["seq", "value"], "next", bits).collect()
    assert {(r.key, r.seq): tuple(r.next) if r.next else None for r in got} == expected


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_nearest_step(spark, bits):
    rnd = random.Random(4)
    points = [("s", rnd.randint(0, 300), float(i)) for i in range(60)]
    points += [("t", 5, 1.0)]
    wanted = [("s", rnd.randint(-20, 330)) for _ in range(80)] * 2 + [("t", 0), ("none", 1)]
    got = nearest_step(
        spark.createDataFrame(wanted, "series string, step bigint"),
        spark.createDataFrame(points, "series string, step bigint, y double"),
        bits=bits,
    ).collect()
    expected = set()
    for series, step in set(wanted):
        own = [(abs(p[1] - step), p[1], p[2]) for p in points if p[0] == series]
        if own:
            _, near, y = min(own)
            expected.add((series, step, near, y))
    assert {tuple(r) for r in got} == expected
    assert len(got) == len(expected)


def test_turns_to_pairs_skips_other_roles(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
        (1, 3, "user", "u2"), (1, 4, "user", "u3"), (1, 5, "assistant", "a3"), (2, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    pairs = {(r.prompt, r.response) for r in turns_to_pairs(df, bits=1).collect()}
    assert pairs == {("u1", "a1"), ("u3", "a3")}


def test_orders_far_apart(spark):
    """One key, each row in a slice of its own: the carries are spread over blocks."""
    step = 3_000_000 * 1024
    rows = [("hot", n * step, n % 7 or None) for n in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    value = F.coalesce("value", F.lit(0))
    got = running_sum(df, ["key"], "seq", value, "total").collect()
    total, expected = 0, {}
    for _, seq, v in rows:
        total += v or 0
        expected[seq] = total
    assert {r.seq: r.total for r in got} == expected
    blocks = df.select(F.shiftright("seq", 40)).distinct().count()
    assert blocks > 1 and len(rows) / blocks < len(rows) / 10
    following = next_row(df, ["key"], "seq", ["seq"], "after").collect()
    assert {r.seq: r.after and r.after.seq for r in following} == {
        seq: seq + step if n + 1 < len(rows) else None for n, (_, seq, _) in enumerate(rows)
    }
    near = fill(df, ["key"], "seq", "value", "before", "after").collect()
    for r in near:
        n = r.seq // step
        before = n if n % 7 else n - 1
        after = n if n % 7 else n + 1
        assert (r.before and r.before.at) == (before * step if before >= 0 else None)
        assert (r.after and r.after.at) == (after * step if after < len(rows) else None)
