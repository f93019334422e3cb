"""Tiers of tool calls: rule tables, their validation, classification and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.globs import glob_regex
from millrace.session import checkpointed

# Tiers, limits and the built-in rule packs (glob patterns per tier, in order).
TIERS = ("pass", "undoable", "hold")
DEFAULT_TIER = "undoable"
UNDO_WINDOW_MS = 30 * 60 * 1000
MAX_SNAPSHOT_BYTES = 50 * 1024 * 1024
STATUS_OF_TIER = {"pass": "passed", "undoable": "applied", "hold": "held"}
ESCALATED = "escalated: snapshot exceeds maxSnapshotBytes"
UNKNOWN_PATHS = "held: the paths in its arguments cannot be told"
CONTROL_TOOLS = ("ledger", "undo", "commit")

BUILT_IN = (
    (
        "pass",
        "read*|list*|get*|search*|glob*|grep*|stat*|fetch*|query*|describe*|view*|head*|find*|"
        "check*|show*|count*",
    ),
    (
        "hold",
        "delete*|remove*|drop*|destroy*|truncate*|purge*|wipe*|send*|publish*|deploy*|release*|"
        "pay*|transfer*|charge*|refund*|cancel*|merge*|force*|reset*|revoke*|terminate*|kill*|"
        "execute*|apply*",
    ),
)
PROFILES = {
    "github": (
        ("pass", "search*|list*|get*|read*|download*|compare*|check*"),
        (
            "hold",
            "merge*|close*|delete*|push*|create_or_update*|create_pull*|create_issue*|"
            "create_release*|create_repository*|fork*|transfer*|submit*|dismiss*|request*|"
            "add_*comment*|update*|edit*|assign*|lock*|unlock*|enable*|disable*|rerun*|dispatch*",
        ),
    ),
    "supabase": (
        ("pass", "list*|get*|generate*|search*|fetch*"),
        (
            "hold",
            "execute*|apply*|deploy*|delete*|drop*|truncate*|pause*|restore*|reset*|merge*|"
            "rebase*|create_project*|create_branch*|update*|insert*|upsert*",
        ),
    ),
    "postgres": (
        ("pass", "query|select*|describe*|list*|get*|explain*"),
        (
            "hold",
            "execute*|insert*|update*|upsert*|delete*|drop*|alter*|create*|truncate*|grant*|"
            "revoke*",
        ),
    ),
    "slack": (
        ("pass", "list*|get*|search*|read*|conversations_history*|users_*"),
        (
            "hold",
            "send*|post*|chat_*|reply*|react*|upload*|invite*|kick*|archive*|set*|update*|delete*",
        ),
    ),
    "gmail": (
        ("pass", "list*|get*|search*|read*|fetch*"),
        (
            "hold",
            "send*|delete*|trash*|modify*|create_draft*|update*|batch*|archive*|move*|label*",
        ),
    ),
}


@dataclass(frozen=True)
class Rule:
    """A glob pattern giving a tier, for one server if one is named."""

    match: str
    tier: str
    server: str | None = None


def _pack(entries) -> list[Rule]:
    return [Rule(globs, tier) for tier, globs in entries]


def rule_packs(spark: SparkSession) -> DataFrame:
    """All built-in rules: ``(pack, precedence, match, tier)``."""
    packs = {"built-in": BUILT_IN, **PROFILES}
    rows = [
        (name, i, rule.match, rule.tier)
        for name, entries in packs.items()
        for i, rule in enumerate(_pack(entries))
    ]
    return spark.createDataFrame(rows, "pack string, precedence int, match string, tier string")


def tier_of(
    server: Column,
    tool: Column,
    rules: Sequence[Rule] = (),
    profiles: Mapping[str, str] | None = None,
    default: str = DEFAULT_TIER,
) -> Column:
    """Tier of a call: user rules, then the server's profile, then built-in rules.

    ``profiles`` maps servers to profile names. Rules are part of the configuration, so they
    become one ``CASE`` whose patterns are compiled once; classifying moves no rows.
    """
    tests: list[tuple[Column, str]] = []
    for rule in rules:
        hit = tool.rlike(glob_regex(rule.match))
        tests.append(((server == rule.server) & hit if rule.server else hit, rule.tier))
    by_profile: dict[str, list[str]] = {}
    for name, profile in (profiles or {}).items():
        by_profile.setdefault(profile, []).append(name)
    for profile, servers in by_profile.items():
        for rule in _pack(PROFILES.get(profile, ())):
            tests.append((server.isin(servers) & tool.rlike(glob_regex(rule.match)), rule.tier))
    for rule in _pack(BUILT_IN):
        tests.append((tool.rlike(glob_regex(rule.match)), rule.tier))
    choice = F
    for test, tier in tests:
        choice = choice.when(test, tier)
    return choice.otherwise(default)


def classify(
    actions: DataFrame,
    rules: Sequence[Rule] = (),
    profiles: Mapping[str, str] | None = None,
    default: str = DEFAULT_TIER,
) -> DataFrame:
    """Actions (``server, tool``) with their ``tier``."""
    tier = tier_of(F.col("server"), F.col("tool"), rules, profiles, default)
    return actions.withColumn("tier", tier)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rules that lack a pattern or name no known tier, with the ``problem``."""
    problem = F.when(F.coalesce(F.col("match"), F.lit("")) == "", "needs match").when(
        ~F.coalesce(F.col("tier").isin(list(TIERS)), F.lit(False)), "needs tier pass|undoable|hold"
    )
    return rules.withColumn("problem", problem).where("problem IS NOT NULL")


def validate_servers(servers: DataFrame) -> DataFrame:
    """Servers (``server, profile``) that name an unknown profile, with the ``problem``."""
    named = F.col("profile").isNotNull() & (F.col("profile") != "")
    known = ", ".join(PROFILES)
    problem = F.concat(
        F.lit("unknown profile "), F.col("profile"), F.lit(f" (built-in: {known})")
    )
    return servers.where(named & ~F.col("profile").isin(list(PROFILES))).withColumn(
        "problem", problem
    )


def check_config(rules: DataFrame, servers: DataFrame, default: str | None = None) -> None:
    """Raise on the first fault of a configuration; its tables are read until one is found."""
    if servers.isEmpty():
        raise ValueError("servers must list at least one server")
    for faults, what in ((validate_servers(servers), "server"), (validate_rules(rules), "rule")):
        fault = faults.head()
        if fault:
            raise ValueError(f"bad {what}: {fault.problem}")
    if default and default not in TIERS:
        raise ValueError("default tier must be pass|undoable|hold")


def initial_status(actions: DataFrame) -> DataFrame:
    """First status of an action, from its tier after any escalation."""
    choice = F
    for tier, status in STATUS_OF_TIER.items():
        choice = choice.when(F.col("tier") == tier, status)
    return actions.withColumn("status", choice)


def escalate(
    actions: DataFrame, sizes: DataFrame, budget: int = MAX_SNAPSHOT_BYTES
) -> DataFrame:
    """Undoable actions whose existing files exceed the budget become held.

    ``sizes`` has ``id, path, existed, size``, one row per path an action touches; a row without
    a path says that its paths could not be told, and such an action is held as well. Adds
    ``tier``, ``note`` and ``has_undo``: an undoable action with any path within the budget
    can be undone.
    """
    touched = sizes.groupBy("id").agg(
        F.count("path").alias("__paths"),
        F.sum(F.when(F.col("existed"), F.col("size"))).alias("__bytes"),
        F.max(F.col("path").isNull()).alias("__unknown"),
    )
    undoable = F.col("tier") == "undoable"
    over = undoable & (F.coalesce(F.col("__bytes"), F.lit(0)) > budget)
    unknown = undoable & ~over & F.coalesce(F.col("__unknown"), F.lit(False))
    within = undoable & ~over & ~unknown & (F.coalesce(F.col("__paths"), F.lit(0)) > 0)
    return (
        actions.join(touched, "id", "left")
        .withColumn("has_undo", within)
        .withColumn("note", F.when(over, ESCALATED).when(unknown, UNKNOWN_PATHS))
        .withColumn("tier", F.when(over | unknown, "hold").otherwise(F.col("tier")))
        .drop("__paths", "__bytes", "__unknown")
    )


def expose_tools(tools: DataFrame, control_prefix: str = "audit_") -> DataFrame:
    """Names under which tools are offered: ``(exposed, server, tool)``.

    ``tools`` has ``server, tool, attach_order``, which is unique. A tool keeps its name unless
    an earlier one is offered under it, by its own name or with its server's name in front; it
    then gets its server's name in front. Three control tools are added and win their names.
    """
    # The first holder per name is an aggregate; ranking a common name would need one task.
    first = tools.groupBy("tool").agg(F.min("attach_order").alias("first"))
    named = tools.join(first, "tool").withColumns(
        {"prefixed": F.concat_ws("__", "server", "tool"), "flat": F.col("attach_order") == F.col("first")}
    )
    # A prefixed name may take the name of a later tool, which is then prefixed itself and may
    # do the same. Names get longer every time, so this ends; most catalogues settle at once.
    while True:
        taken = (
            named.where(~F.col("flat"))
            .groupBy(F.col("prefixed").alias("tool"))
            .agg(F.min("attach_order").alias("taken"))
        )
        lost = F.col("flat") & (F.col("taken") < F.col("attach_order"))
        if named.join(taken, "tool").where(lost).isEmpty():
            break
        free = F.col("taken").isNull() | (F.col("taken") >= F.col("attach_order"))
        named = checkpointed(
            named.join(taken, "tool", "left").withColumn("flat", F.col("flat") & free).drop("taken"), "tool-names"
        )
    named = named.select(
        F.when(F.col("flat"), F.col("tool")).otherwise(F.col("prefixed")).alias("exposed"),
        "server", "tool", "attach_order",
    )
    # The last tool attached under an exposed name is the one that is called.
    offered = named.groupBy("exposed").agg(
        F.max_by(F.struct("server", "tool"), "attach_order").alias("t")
    ).select("exposed", "t.server", "t.tool")
    controls = [control_prefix + t for t in CONTROL_TOOLS]
    offered = offered.where(~F.col("exposed").isin(controls))
    names = F.explode(F.lit(controls))
    control = tools.sparkSession.range(1).select(
        names.alias("exposed"), F.lit(None).cast("string").alias("server"),
    ).withColumn("tool", F.col("exposed"))
    return offered.unionByName(control)


def route(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls (``name``) with the server and tool behind the name, or an ``error``."""
    known = tools.select(F.col("exposed").alias("name"), "server", "tool")
    unknown = F.concat(F.lit("Unknown tool: "), F.col("name"))
    routed = calls.join(known, "name", "left")
    return routed.withColumn("error", F.when(F.col("tool").isNull(), unknown))


def failures(routed: DataFrame) -> DataFrame:
    """``failed`` transitions of routed calls that did not succeed.

    ``routed`` has ``id, ts``, an ``is_error`` flag of the tool's answer and the text
    ``raised`` if the call itself broke.
    """
    note = F.when(F.col("raised").isNotNull(), F.col("raised")).otherwise(
        "downstream returned error"
    )
    bad = F.col("error").isNull() & (F.col("raised").isNotNull() | F.coalesce("is_error", F.lit(False)))
    return routed.where(bad).select(
        F.lit("transition").alias("kind"), "id", "ts", F.lit("failed").alias("status"),
        note.alias("note"),
    )


