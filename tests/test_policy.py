from __future__ import annotations

import pytest

from millrace.functions.globs import glob_regex, glob_to_regex
from millrace.operators.paths import argument_paths
from millrace.operators import policy
from millrace.operators.policy import Rule
from pyspark.sql import functions as F


def tiers(spark, calls, **config):
    df = spark.createDataFrame(calls, "server string, tool string")
    return [r.tier for r in policy.classify(df, **config).collect()]


def test_built_in_verbs(spark):
    calls = [
        ("fs", "read_file"), ("fs", "list_directory"), ("fs", "delete_file"),
        ("mail", "send_email"), ("gh", "merge_pull_request"), ("fs", "write_file"),
        ("db", "execute_sql"), ("db", "apply_migration"), ("infra", "deploy_edge_function"),
        ("fs", "create_directory"), ("fs", "READ_FILE"), ("fs", "unread"),
    ]
    assert tiers(spark, calls) == [
        "pass", "pass", "hold", "hold", "hold", "undoable", "hold", "hold", "hold", "undoable",
        "pass", "undoable",
    ]
    assert tiers(spark, [("fs", "write_file")], default="hold") == ["hold"]


def test_profiles_come_between(spark):
    calls = [
        ("gh", "create_pull_request"), ("db", "insert_record"), ("chat", "post_message"),
        ("gh", "search_code"), ("gh", "update_pull_request"), ("other", "create_pull_request"),
    ]
    got = tiers(
        spark, calls,
        rules=[Rule("update_pull_request", "pass", "gh")],
        profiles={"gh": "github", "db": "supabase", "chat": "slack", "other": "none"},
    )
    assert got == ["hold", "hold", "hold", "pass", "pass", "undoable"]


def test_user_rules_and_scope(spark):
    rules = [Rule("delete_scratch*", "pass"), Rule("write*", "hold", "prod")]
    calls = [("fs", "delete_scratch_file"), ("prod", "write_file"), ("fs", "write_file")]
    assert tiers(spark, calls, rules=rules) == ["pass", "hold", "undoable"]


@pytest.mark.parametrize(
    "glob, tool, hit",
    [
        ("a*| |b", "B", True), ("a*", "xa", False), ("a.c", "abc", False), ("a.c", "A.C", True),
        ("(x)*$", "(x)y$", True), ("a|b", "ab", False), (" ", "", True), ("a", "a\n", False),
        ("x\\y", "x\\y", True), ("add_*comment*", "add_a_comment_b", True), ("été*", "été 1", True),
    ],
)
def test_globs(spark, glob, tool, hit):
    df = spark.createDataFrame([(glob, tool)], "glob string, tool string")
    row = df.select(
        F.regexp_like("tool", glob_to_regex(F.col("glob"))).alias("by_column"),
        F.col("tool").rlike(glob_regex(glob)).alias("by_literal"),
    ).head()
    assert (row.by_column, row.by_literal) == (hit, hit)


def test_paths(spark):
    args = [
        '{"path":"/a/b.txt","target_file":"/c.txt","content":"/looks/like/a/path/but/wrong-key",'
        '"nested":{"paths":["/d.txt","relative.txt"]}}',
        '{"profile":"/p","Dest":["/p",["/q"]],"dir":{"note":"/n","x":[{"FOLDER":"/z"}]}}',
        '"/bare"', "not json", None, "[]", '[{"path": "/late"}, {"a": [{"dir": ["/x", "/late"]}]}]',
        '{"file": "{\\"path\\": \\"/text\\"}", "source": "\\/escaped", "a": "[\\"/no\\"]", "n": 1.50, "dest": "\\u002fcode"}',
        '\n {"x": {"y": {"z": [[["/deep"]]], "target": [[["/list"]]]}}}', '{"path": "/broken"',
    ]
    df = spark.createDataFrame(list(enumerate(args)), "id int, args string")
    got = {}
    for r in argument_paths(df).orderBy("id", "position").collect():
        assert r.position == len(got.setdefault(r.id, []))
        got[r.id].append(r.path)
    assert got == {
        0: ["/a/b.txt", "/c.txt", "/d.txt"], 1: ["/p", "/q", "/z"], 6: ["/late", "/x"],
        7: ["/escaped", "/code"], 8: ["/list"],
    }


def test_paths_too_deep_to_tell_are_held(spark):
    deep = lambda n: '{"path": "/a", "x": ' + "[" * n + '"/y"' + "]" * n + "}"
    rows = [("far", deep(100_000)), ("some", deep(6)), ("near", deep(2)), ("none", "{}")]
    calls = spark.createDataFrame(rows, "id string, args string")
    found = argument_paths(calls, levels=5)
    assert {r.id: r.path for r in found.collect()} == {"far": None, "some": None, "near": "/a"}
    actions = calls.select("id", F.lit("undoable").alias("tier"))
    sizes = found.withColumn("existed", F.lit(True)).withColumn("size", F.lit(1).cast("bigint"))
    got = {r.id: (r.tier, r.note, r.has_undo) for r in policy.escalate(actions, sizes).collect()}
    assert got == {
        "far": ("hold", policy.UNKNOWN_PATHS, False), "some": ("hold", policy.UNKNOWN_PATHS, False),
        "near": ("undoable", None, True), "none": ("undoable", None, False),
    }
    assert argument_paths(calls.limit(0)).count() == 0


def test_budget_limit(spark):
    actions = spark.createDataFrame(
        [("over", "undoable"), ("equal", "undoable"), ("none", "undoable"), ("new", "undoable"),
         ("held", "hold")], "id string, tier string",
    )
    sizes = spark.createDataFrame(
        [("over", "/a", True, 1024), ("over", "/b", True, 1), ("equal", "/a", True, 1024),
         ("new", "/c", False, None), ("held", "/a", True, 9999)],
        "id string, path string, existed boolean, size bigint",
    )
    got = policy.initial_status(policy.escalate(actions, sizes, 1024))
    rows = {r.id: (r.tier, r.note, r.has_undo, r.status) for r in got.collect()}
    assert rows == {
        "over": ("hold", policy.ESCALATED, False, "held"),
        "equal": ("undoable", None, True, "applied"),
        "none": ("undoable", None, False, "applied"),
        "new": ("undoable", None, True, "applied"),
        "held": ("hold", None, False, "held"),
    }


def test_exposed_names(spark):
    tools = [("a", "read", 0), ("a", "write", 1), ("b", "read", 2), ("c", "read", 3), ("b", "read", 4)]
    df = spark.createDataFrame(tools, "server string, tool string, attach_order bigint")
    got = {r.exposed: r.server for r in policy.expose_tools(df, "x_").collect()}
    assert got == {
        "read": "a", "write": "a", "b__read": "b", "c__read": "c", "x_ledger": None,
        "x_undo": None, "x_commit": None,
    }


def test_bad_configurations(spark):
    servers = spark.createDataFrame([("gh", "github"), ("x", None)], "server string, profile string")
    rules = spark.createDataFrame([("a*", "pass")], "match string, tier string")
    policy.check_config(rules, servers, "hold")
    with pytest.raises(ValueError, match="default tier"):
        policy.check_config(rules, servers, "maybe")
    with pytest.raises(ValueError, match="at least one"):
        policy.check_config(rules, servers.limit(0))
    with pytest.raises(ValueError, match="needs tier"):
        policy.check_config(rules.selectExpr("match", "'no' AS tier"), servers)
    with pytest.raises(ValueError, match="unknown profile gitlab"):
        policy.check_config(rules, servers.selectExpr("server", "'gitlab' AS profile"))


def test_tool_names_that_clash(spark):
    """A prefixed name may take a later tool's own; control tools win theirs; no call is lost."""
    from millrace.operators.policy import expose_tools, route

    tools = spark.createDataFrame(
        [("x", "b", 1), ("a", "b", 2), ("y", "a__b", 3), ("z", "audit_undo", 4), ("z", "c", 5)],
        "server string, tool string, attach_order int",
    )
    offered = expose_tools(tools)
    found = {(r.exposed, r.server, r.tool) for r in offered.collect()}
    assert {("b", "x", "b"), ("a__b", "a", "b"), ("y__a__b", "y", "a__b"), ("c", "z", "c")} <= found
    assert ("audit_undo", None, "audit_undo") in found and len(found) == 7
    calls = spark.createDataFrame([("a__b",), ("y__a__b",), ("audit_undo",), ("no",)], "name string")
    assert route(calls, offered).count() == 4


def test_a_missing_argument_list_is_hashed_as_null(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text

    frame = spark.createDataFrame([("s", "t", None), ("s", "t", "null")], "s string, t string, a string")
    name = next(n for n in dir(text) if "fingerprint" in n)
    assert len({r[0] for r in frame.select(getattr(text, name)(F.col("s"), F.col("t"), F.col("a"))).collect()}) == 1
