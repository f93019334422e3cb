"""The audit ledger: replay of events, expiry, repeated holds, undo and commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import SLICE_BITS, running_sum
from millrace.functions.text import fingerprint
from millrace.operators.policy import UNDO_WINDOW_MS
from millrace.session import checkpointed

# Fields of an audit line, its default length, and the expiry note.
AUDIT_FIELDS = ("id", "ts", "server", "tool", "tier", "status", "note")
AUDIT_LIMIT = 20
EXPIRED = "undo window elapsed"
UNDONE = "undone"

RECORD = ("ts", "server", "tool", "args", "tier", "status", "note", "undo")


def replay(events: DataFrame) -> DataFrame:
    """Current state of every action: one row per id, with ``first_seq`` as its place.

    An action event sets the whole record, a later transition its status and, unless empty,
    its note; transitions of unknown ids are ignored. One aggregate, so a busy id is
    combined before the shuffle; the same plan runs on a stream of events.
    """
    fields = [c for c in RECORD if c in events.columns]
    is_action = F.col("kind") == "action"
    set_at = F.when(is_action, F.col("seq"))
    noted = (F.col("kind") == "transition") & (F.coalesce(F.col("note"), F.lit("")) != "")
    note_at = F.when(noted, F.col("seq"))
    # A transition before the first action names an unknown id. It can only come last if
    # there is no action at all, in which case the id is dropped below.
    folded = events.groupBy("id").agg(
        F.max_by(F.struct(*fields), set_at).alias("record"),
        F.max(set_at).alias("set_at"),
        F.min(set_at).alias("first_seq"),
        F.max_by("status", "seq").alias("status"),
        F.max_by("note", note_at).alias("noted"),
        F.max(note_at).alias("noted_at"),
    )
    note = F.when(F.col("noted_at") > F.col("set_at"), F.col("noted")).otherwise(
        F.col("record.note")
    )
    special = {"status": F.col("status"), "note": note}
    return folded.where("set_at IS NOT NULL").select(
        "id",
        "first_seq",
        *[special.get(c, F.col(f"record.{c}")).alias(c) for c in fields],
    )


def audit(state: DataFrame, limit: int = AUDIT_LIMIT) -> DataFrame:
    """The newest actions, latest first."""
    return state.orderBy(F.col("first_seq").desc()).limit(limit).select(*AUDIT_FIELDS)


def millis(ts: Column) -> Column:
    """Milliseconds of an ISO 8601 text."""
    return F.unix_millis(F.try_to_timestamp(ts))


def expired(status: Column, ts_millis: Column, now_millis: Column, window_ms: int) -> Column:
    """True for an applied action strictly older than the window."""
    return (status == "applied") & (now_millis - ts_millis > window_ms)


def sweep(state: DataFrame, now_millis: Column, window_ms: int = UNDO_WINDOW_MS) -> DataFrame:
    """``final`` transitions of applied actions whose window has elapsed."""
    old = expired(F.col("status"), millis(F.col("ts")), now_millis, window_ms)
    return state.where(old).select(
        F.lit("transition").alias("kind"), "id", F.lit("final").alias("status"),
        F.lit(EXPIRED).alias("note"),
    )


def with_fingerprint(calls: DataFrame) -> DataFrame:
    """Calls (``server, tool, args``) with the fingerprint ``fp`` of what they would do."""
    fp = fingerprint(F.col("server"), F.col("tool"), F.col("args"))
    return calls.withColumn("fp", fp)


def dedupe_holds(
    calls: DataFrame, releases: DataFrame, bits: int = SLICE_BITS, folder: str | None = None
) -> DataFrame:
    """The id each held call stands under: ``(seq, id, fp, held_as, repeat)``.

    ``calls`` has ``seq, id, fp``; ``releases`` holds the ledger's transitions out of
    ``held`` as ``seq, id``. An identical call is a repeat while the earlier one is still
    held; after its release the next call is recorded anew. Intermediates go below ``folder`` if the
    caller names one; the result reads them.
    """
    # Only these narrow columns travel. Both tables below are used twice and written once.
    marked = calls.select("seq", "id", "fp")
    first = releases.groupBy("id").agg(F.min("seq").alias("seq"))
    freed = first.join(marked.select("id", "fp"), "id").select("seq", "fp")
    events = checkpointed(marked.unionByName(freed, allowMissingColumns=True), "hold-events", folder)
    is_call = F.col("id").isNotNull()
    released = F.when(is_call, 0).otherwise(1)
    turns = running_sum(events, ["fp"], "seq", released, "epoch", bits).where(is_call)
    turns = checkpointed(turns, "hold-turns", folder)
    holder = turns.groupBy("fp", "epoch").agg(F.min_by("id", "seq").alias("held_as"))
    return turns.join(holder, ["fp", "epoch"]).select(
        "seq", "id", "fp", "held_as", (F.col("id") != F.col("held_as")).alias("repeat")
    )


def first_commands(commands: DataFrame, agents_may_commit: bool = False) -> DataFrame:
    """First undo and first allowed commit per id; also for streams.

    ``commands`` has ``seq, id, op`` and optionally ``by`` (``human`` or ``agent``).
    """
    commit = F.col("op") == "commit"
    if "by" in commands.columns and not agents_may_commit:
        commit = commit & (F.col("by") != "agent")
    return commands.groupBy("id").agg(
        F.min(F.when(F.col("op") == "undo", F.col("seq"))).alias("undo_seq"),
        F.min(F.when(commit, F.col("seq"))).alias("commit_seq"),
    )


def command_plan(state: DataFrame, firsts: DataFrame, tools: DataFrame) -> DataFrame:
    """When each commanded action is committed, discarded or undone.

    ``state`` has ``id, status, server, tool, has_undo``, ``tools`` the ``server, tool``
    pairs still offered.

    An action changes at most twice (held, committed, undone), and which commands do it
    follows from the first undo and the first allowed commit of its id. So many commands
    for one id are an aggregate, not a sequence.
    """
    offered = tools.select("server", "tool").distinct().withColumn("__offered", F.lit(True))
    held = F.col("was") == "held"
    before_undo = F.col("commit_seq") < F.coalesce("undo_seq", F.lit((1 << 63) - 1))
    commit_at = F.when(held & F.col("__offered") & before_undo, F.col("commit_seq"))
    discard_at = F.when(held & F.col("commit_at").isNull(), F.col("undo_seq"))
    ran = F.col("was").isin("applied", "committed") | F.col("commit_at").isNotNull()
    undo_at = F.when(F.col("has_undo") & ran, F.col("undo_seq"))
    return (
        state.select("id", F.col("status").alias("was"), "server", "tool", "has_undo")
        .join(firsts, "id")
        .join(offered, ["server", "tool"], "left")
        .withColumn("commit_at", commit_at)
        .withColumn("discard_at", discard_at)
        .withColumn("undo_at", undo_at)
        .select(
            "id", "was", "has_undo", F.col("__offered").isNotNull().alias("offered"),
            "commit_at", "discard_at", "undo_at",
        )
    )


def apply_commands(
    state: DataFrame,
    commands: DataFrame,
    tools: DataFrame,
    agents_may_commit: bool = False,
    undone: str = UNDONE,
) -> DataFrame:
    """Outcome of every command: ``(seq, id, op, accepted, status, reason)``.

    ``status`` is the action's status after the command, null for an unknown id; ``reason``
    tells why a command was rejected.
    """
    plan = command_plan(state, first_commands(commands, agents_may_commit), tools)
    seq = F.col("seq")
    status = (
        F.when(seq >= F.col("undo_at"), undone)
        .when(seq >= F.col("discard_at"), "discarded")
        .when(seq >= F.col("commit_at"), "committed")
        .otherwise(F.col("was"))
    )
    moments = [F.col("commit_at"), F.col("discard_at"), F.col("undo_at")]
    accepted = F.exists(F.array(*moments), lambda m: m.eqNullSafe(seq))
    agent = F.lit(False)
    if "by" in commands.columns and not agents_may_commit:
        agent = (F.col("op") == "commit") & (F.col("by") == "agent")
    done = commands.join(plan, "id", "left").select(
        "seq", "id", "op", accepted.alias("accepted"), status.alias("status"), "offered",
        agent.alias("agent"),
    )
    return done.withColumn("reason", F.when(~F.col("accepted"), _rejection())).drop(
        "offered", "agent"
    )


def _rejection() -> Column:
    """Why a command was rejected; the status has not changed then."""
    status = F.col("status")
    commit = (
        F.when(status != "held", F.concat(F.lit("is "), status, F.lit(", not held")))
        .when(~F.col("offered"), "tool no longer available")
    )
    undo = F.when(status.isin("applied", "committed"), "nothing recoverable was captured").otherwise(
        F.concat(F.lit("is "), status, F.lit(" and cannot be undone"))
    )
    return (
        F.when(F.col("agent"), "agents may not commit")
        .when(status.isNull(), "no such action")
        .when(F.col("op") == "commit", commit)
        .otherwise(undo)
    )


def after_commands(
    state: DataFrame, firsts: DataFrame, tools: DataFrame, undone: str = UNDONE
) -> DataFrame:
    """``(id, status)`` of every commanded action after all its commands."""
    status = (
        F.when(F.col("undo_at").isNotNull(), undone)
        .when(F.col("discard_at").isNotNull(), "discarded")
        .when(F.col("commit_at").isNotNull(), "committed")
        .otherwise(F.col("was"))
    )
    return command_plan(state, firsts, tools).select("id", status.alias("status"))
