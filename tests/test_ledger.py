from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ledger, registry

EVENTS = "seq bigint, kind string, id string, ts string, tier string, status string, note string"
CALLS = "seq bigint, id string, server string, tool string, args string"


def test_replay_of_one_action(spark):
    rows = [
        (1, "transition", "aa", "t0", None, "failed", "too early"),
        (2, "action", "aa", "t1", "hold", "held", None),
        (3, "transition", "aa", "t2", None, "committed", None),
        (4, "transition", "zz", "t3", None, "committed", None),
    ]
    got = ledger.replay(spark.createDataFrame(rows, EVENTS)).collect()
    assert [(r.id, r.ts, r.status, r.note, r.first_seq) for r in got] == [
        ("aa", "t1", "committed", None, 2)
    ]


def replayed(events):
    state = {}
    for seq, kind, id_, ts, tier, status, note in events:
        if kind == "action":
            first = state[id_]["first_seq"] if id_ in state else seq
            state[id_] = {"ts": ts, "tier": tier, "status": status, "note": note, "first_seq": first}
        elif id_ in state:
            state[id_]["status"] = status
            if note:
                state[id_]["note"] = note
    return state


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_many(spark, seed):
    rnd = random.Random(seed)
    events = [
        (
            i, rnd.choice(["action", "transition", "transition"]), rnd.choice("aaabcdefgh"), f"t{i}",
            rnd.choice(["pass", "hold"]), rnd.choice(["held", "final", "failed"]),
            rnd.choice([None, "", f"n{i}"]),
        )
        for i in range(120)
    ]
    df = spark.createDataFrame(rnd.sample(events, len(events)), EVENTS)
    got = {r.id: {k: r[k] for k in ("ts", "tier", "status", "note", "first_seq")}
           for r in ledger.replay(df).collect()}
    assert got == replayed(events)


def test_sweep_is_strict(spark):
    times = ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.001Z", "2023-12-31T23:59:59.999Z", "?"]
    rows = [(f"s{i}", t, "applied") for i, t in enumerate(times)] + [("held", times[2], "held")]
    state = spark.createDataFrame(rows, "id string, ts string, status string")
    now = F.lit(1_704_067_200_000 + 60_000)
    got = ledger.sweep(state, now, 60_000).collect()
    assert [(r.id, r.status, r.note) for r in got] == [("s2", "final", ledger.EXPIRED)]


def held(calls):
    """What should come out: walk calls and releases in order."""
    open_, out = {}, {}
    for seq, id_, key in sorted(calls):
        if key is None:
            open_ = {k: v for k, v in open_.items() if v != id_}
        else:
            open_.setdefault(key, id_)
            out[id_] = open_[key]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bits", [1, 4, 20])
def test_repeated_holds(spark, seed, bits):
    rnd = random.Random(seed)
    open_, events = {}, []
    for seq in range(150):
        if open_ and rnd.random() < 0.2:
            key = rnd.choice(sorted(open_))
            events.append((seq, open_.pop(key), None))
        else:
            key = rnd.choice("aaaab")
            open_.setdefault(key, f"c{seq}")
            events.append((seq, f"c{seq}", key))
    calls = [(s, i, "srv", k, "{}") for s, i, k in events if k]
    releases = [(s, i) for s, i, k in events if not k]
    got = ledger.dedupe_holds(
        ledger.with_fingerprint(spark.createDataFrame(calls, CALLS)),
        spark.createDataFrame(releases, "seq bigint, id string"), bits,
    ).collect()
    assert {r.id: r.held_as for r in got} == held(events)
    assert all(r.repeat == (r.id != r.held_as) for r in got)


def test_fingerprint_depends_on_all_parts(spark):
    import hashlib
    import json

    calls = [(1, "a", 's"1', "t/é", '{"p":1}'), (2, "b", 's"1', "t/é", '{"p":2}')]
    df = spark.createDataFrame(calls, CALLS)
    rows = df.select(ledger.fingerprint(F.col("server"), F.col("tool"), F.col("args"))).collect()
    text = json.dumps(['s"1', "t/é", {"p": 1}], separators=(",", ":"), ensure_ascii=False)
    assert rows[0][0] == hashlib.sha256(text.encode()).hexdigest()
    assert rows[0][0] != rows[1][0]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("agents", [False, True])
def test_commands_in_order(spark, seed, agents):
    rnd = random.Random(seed)
    state = {
        f"i{n}": (rnd.choice(["held", "applied", "committed", "passed", "final"]),
                  rnd.choice(["s", "gone"]), "t", rnd.random() < 0.6)
        for n in range(40)
    }
    commands = [
        (i, f"i{rnd.randint(0, 44)}", rnd.choice(["undo", "commit"]), rnd.choice(["human", "agent"]))
        for i in range(160)
    ]
    now = {i: s[0] for i, s in state.items()}
    expected = {}
    for seq, id_, op, by in commands:
        was, result = now.get(id_), None
        if op == "undo" and was == "held":
            result = "discarded"
        elif op == "undo" and was in ("applied", "committed") and state[id_][3]:
            result = "undone"
        elif op == "commit" and was == "held" and state[id_][1] == "s" and (agents or by == "human"):
            result = "committed"
        if result:
            now[id_] = result
        expected[seq] = (result is not None, now.get(id_))
    states = spark.createDataFrame(
        [(i, *s) for i, s in state.items()],
        "id string, status string, server string, tool string, has_undo boolean",
    )
    sent = spark.createDataFrame(commands, "seq bigint, id string, op string, by string")
    tools = spark.createDataFrame([("s", "t")], "server string, tool string")
    got = ledger.apply_commands(states, sent, tools, agents).collect()
    assert {r.seq: (r.accepted, r.status) for r in got} == expected
    firsts = ledger.first_commands(sent, agents)
    after = {r.id: r.status for r in ledger.after_commands(states, firsts, tools).collect()}
    assert after == {i: now[i] for i in {c[1] for c in commands} & set(state)}


def test_deleted_rows_stay_gone(spark):
    log = [
        (1, 1, "status", "update", "running"), (1, 2, None, "delete", None), (1, 3, "name", "update", "x"),
        (2, 1, "status", "update", "running"), (2, 2, "status", "update", None), (2, 3, None, "delete", None),
        (2, 4, "name", "update", "late"), (3, 1, "name", "update", "a"), (3, 2, "name", "update", None),
    ]
    df = spark.createDataFrame(log, "id bigint, seq bigint, field string, op string, value string")
    got = {r.id: (r.status, r.name) for r in registry.fold_deletes(df, ["status", "name"]).collect()}
    assert got == {1: ("running", "x"), 3: (None, None)}


def test_hyperparameters(spark):
    spec = spark.createDataFrame(
        [("t", "n", "int", "3"), ("t", "f", "float", "0.5"), ("t", "b", "bool", "true"), ("t", "s", "str", "d")],
        "task string, name string, type string, default string",
    )
    users = [
        ({"n": "12", "f": "1e-3", "b": "YES", "s": "x", "z": "1"}, ("12", "0.001", "true", "x")),
        ({"n": "3.7", "f": "abc", "b": "no", "s": ""}, ("3", "0.5", "false", "d")),
        ({"n": " 1_000 ", "f": "2", "b": "", "s": " "}, ("1000", "2.0", "true", " ")),
        ({"n": None, "f": "1d"}, ("3", "0.5", "true", "d")),
    ]
    df = spark.createDataFrame(
        [(i, "t", u) for i, (u, _) in enumerate(users)], "job int, task string, values map<string,string>"
    )
    got = {(r.job, r.name): r.value for r in registry.merge_hyperparams(spec, df).collect()}
    for i, (_, expected) in enumerate(users):
        values = tuple(got[i, n] for n in "nfbs")
        assert (values[0], float(values[1]), *values[2:]) == (expected[0], float(expected[1]), *expected[2:])
