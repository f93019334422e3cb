"""Queries on tool calls, policies and the audit ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.globs import glob_to_regex
from millrace.functions.ordered import running_sum
from millrace.operators import ledger, policy
from millrace.operators.paths import argument_paths
from millrace.plans.common import nulled, query, sql_list, table
from millrace.session import checkpointed, workspace
from millrace.sources.jsonlines import append_jsonl, read_ledger
from millrace.streaming import audit
from millrace.streaming.tables import current_rows

VERBS = ["read", "delete", "write", "create_pull", "merge", "insert", "post", "query", "users"]

CALLS = f"""
    SELECT event_id, 'NATION_' || user_id % 25 AS server,
           [{sql_list(VERBS)}][event_id % 9 + 1] || '_' || event_type AS tool, event_type, props,
           user_id, value, ts
    FROM events
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as tool calls: nations as servers, verbs before the event type as tools."""
    verb = F.get(F.lit(VERBS), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("server"),
        F.concat_ws("_", verb, "event_type").alias("tool"),
        "event_type", "props", "user_id", "value", "ts",
    )


def like_sql(globs: str, tool: str = "tool") -> str:
    """A glob pattern as LIKE tests."""
    tests = []
    for part in (p.strip() for p in globs.split("|")):
        if part:
            text = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            tests.append(f"{tool} ILIKE '{text.replace('*', '%')}' ESCAPE '\\'")
    return "(" + " OR ".join(tests) + ")"


@query(
    "g_glob",
    r"""
    SELECT event_id, regex, regexp_matches(tool, regex) AS hit
    FROM (SELECT event_id, upper(event_type) AS tool,
                 '(?i)^(?:' || substr(event_type, 1, 1) || '.*|x\.y.*|.*' || user_id % 7
                 || '\[\$\].*)\z' AS regex FROM events)
    UNION ALL
    SELECT -1 - event_id, '(?i)^(?:.*' || substr(event_type, 2, 2) || '.*)\z',
           contains(event_type, substr(event_type, 2, 2)) FROM events
    """,
)
def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    digit = (F.col("user_id") % 7).cast("string")
    many = F.concat(
        F.substring("event_type", 1, 1), F.lit("* |  | x.y*|*"), digit, F.lit("[$]*")
    )
    inner = F.concat(F.lit("*"), F.upper(F.substring("event_type", 2, 2)), F.lit("*"))
    first = events.select("event_id", F.upper("event_type").alias("tool"), many.alias("glob"))
    second = events.select(-1 - F.col("event_id"), "event_type", F.lower(inner))
    patterns = first.unionAll(second).select("event_id", "tool", glob_to_regex(F.col("glob")).alias("regex"))
    return patterns.select("event_id", "regex", F.regexp_like("tool", F.col("regex")).alias("hit"))


USER_RULES = [
    policy.Rule("delete_e*", "pass"),
    policy.Rule("write*", "hold", "NATION_3"),
    policy.Rule("users_view | *_signup", "undoable", "NATION_4"),
]
SERVER_PROFILES = {
    "NATION_1": "github", "NATION_2": "supabase", "NATION_4": "slack", "NATION_5": "postgres",
    "NATION_6": "gmail", "NATION_7": "github",
}


def _tier_sql() -> str:
    tests = []
    for r in USER_RULES:
        scope = f"server = '{r.server}' AND " if r.server else ""
        tests.append(f"WHEN {scope}{like_sql(r.match)} THEN '{r.tier}'")
    for server, profile in SERVER_PROFILES.items():
        for tier, globs in policy.PROFILES[profile]:
            tests.append(f"WHEN server = '{server}' AND {like_sql(globs)} THEN '{tier}'")
    for tier, globs in policy.BUILT_IN:
        tests.append(f"WHEN {like_sql(globs)} THEN '{tier}'")
    return f"CASE {' '.join(tests)} ELSE '{policy.DEFAULT_TIER}' END"


@query("g_classify", f"SELECT event_id, server, tool, {_tier_sql()} AS tier FROM ({CALLS})")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls(spark, sf_dir).select("event_id", "server", "tool")
    return policy.classify(found, USER_RULES, SERVER_PROFILES)


def _packs_sql() -> str:
    parts = []
    for pack, entries in {"built-in": policy.BUILT_IN, **policy.PROFILES}.items():
        for i, (tier, match) in enumerate(entries):
            parts.append(
                f"SELECT '{pack}' AS pack, {i} AS precedence, '{match}' AS match, '{tier}' AS tier,"
                f" count(*) FILTER ({like_sql(match)}) AS calls FROM ({CALLS})"
            )
    return " UNION ALL ".join(parts)


@query("g_rule_packs", _packs_sql())
def rule_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every built-in rule with the number of calls it matches, in one scan."""
    packs = policy.rule_packs(spark)
    rules = packs.orderBy("pack", "precedence").collect()
    tool = F.col("tool")
    counts = calls(spark, sf_dir).agg(
        F.array(*[F.count_if(tool.rlike(policy.glob_regex(r.match))) for r in rules]).alias("n")
    )
    each = counts.select(F.posexplode("n").alias("i", "calls"))
    fields = ("pack", "precedence", "match", "tier")
    named = {f: F.get(F.lit([r[f] for r in rules]), F.col("i")).alias(f) for f in fields}
    return each.select(*named.values(), "calls")


BAD_RULES = """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL
                          ELSE event_type || '*' END AS match,
           CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'undoable'
                           WHEN 'purchase' THEN 'hold' WHEN 'error' THEN 'block' END AS tier
    FROM events
"""


@query(
    "g_validate_rules",
    f"""
    SELECT event_id, match, tier, CASE WHEN coalesce(match, '') = '' THEN 'needs match'
                                       ELSE 'needs tier pass|undoable|hold' END AS problem
    FROM ({BAD_RULES})
    WHERE coalesce(match, '') = '' OR coalesce(tier, '') NOT IN ('pass', 'undoable', 'hold')
    """,
)
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    match = F.when(F.col("event_id") % 7 == 0, "").otherwise(
        nulled("event_id", 11, "m")
    )
    tier = F.when(kind == "view", "pass").when(kind == "click", "undoable").when(
        kind == "purchase", "hold"
    ).when(kind == "error", "block")
    rules = table(spark, sf_dir, "events").withColumn("m", F.concat(kind, F.lit("*"))).select(
        "event_id", match.alias("match"), tier.alias("tier")
    )
    return policy.validate_rules(rules)


@query(
    "g_validate_servers",
    f"""
    SELECT s_name AS server, 'unknown profile gitlab (built-in: {", ".join(policy.PROFILES)})' AS problem
    FROM supplier WHERE s_nationkey % 3 = 1
    """,
)
def validate_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey") % 3
    servers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("server"),
        F.when(nation == 0, "github").when(nation == 1, "gitlab").alias("profile"),
    )
    return policy.validate_servers(servers).select("server", "problem")


# ---------------------------------------------------------------- the ledger

STATUSES = {
    "click": "applied", "view": "passed", "purchase": "committed", "signup": "held",
    "error": "failed",
}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items()) + " END"

LEDGER = f"""
    SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'action' ELSE 'transition' END AS kind,
           'a' || user_id AS id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
           server, tool, props AS args, event_type AS tier, {STATUS_SQL} AS status,
           CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'note ' || event_id END AS note
    FROM ({CALLS})
"""


def status_of(kind: Column) -> Column:
    choice = F
    for name, status in STATUSES.items():
        choice = choice.when(kind == name, status)
    return choice


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as ledger lines; an id is a user, every fifth line records an action."""
    action = F.col("event_id") % 5 == 0
    note = F.when(F.col("event_id") % 4 == 0, "").when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))
    )
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return calls(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.when(action, "action").otherwise("transition").alias("kind"),
        F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("id"),
        hour.alias("ts"), "server", "tool", F.col("props").alias("args"),
        F.col("event_type").alias("tier"), status_of(F.col("event_type")).alias("status"),
        note.alias("note"),
    )


STATE = f"""
    WITH lines AS ({LEDGER}),
    known AS (SELECT id, min(seq) AS first_seq, max(seq) AS set_at FROM lines
              WHERE kind = 'action' GROUP BY 1),
    later AS (
      SELECT k.id, arg_max(status, seq) AS status,
             arg_max(note, seq) FILTER (note <> '' AND seq > set_at) AS note
      FROM known k JOIN lines l ON k.id = l.id AND seq >= set_at GROUP BY 1)
    SELECT k.id, first_seq, l.ts, l.server, l.tool, l.args, l.tier, t.status,
           coalesce(t.note, l.note) AS note
    FROM known k JOIN lines l ON l.seq = k.set_at JOIN later t ON t.id = k.id
"""


@query("g_ledger_replay", STATE)
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "ledger")
    append_jsonl(ledger_events(spark, sf_dir), folder)
    return ledger.replay(read_ledger(spark, folder)).drop("undo")


@query("g_ledger_stream", STATE)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = workspace(spark, "ledger"), workspace(spark, "ledger-state")
    events = ledger_events(spark, sf_dir)
    for part in range(3):
        append_jsonl(events.where(F.col("seq") % 3 == part), folder)
    lines = read_ledger(spark, folder, stream=True, max_files=4)
    audit.stream_replay(lines, out, workspace(spark, "ledger-cp")).awaitTermination()
    return current_rows(spark, out, ["id"]).where("first_seq IS NOT NULL").drop("undo")


@query(
    "g_audit",
    f"SELECT id, ts, server, tool, tier, status, note FROM ({STATE}) ORDER BY first_seq DESC LIMIT 20",
)
def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.audit(ledger.replay(ledger_events(spark, sf_dir)))


SWEEP_NOW = 1_705_276_800_000  # 2024-01-15, on the hour as the ledger's times are
SWEEP_WINDOW = 5 * 24 * 3600 * 1000


@query(
    "g_sweep",
    f"""
    SELECT 'transition' AS kind, 'e' || seq AS id, 'final' AS status, '{ledger.EXPIRED}' AS note
    FROM ({LEDGER}) WHERE status = 'applied' AND {SWEEP_NOW} - epoch_ms(ts::TIMESTAMPTZ) > {SWEEP_WINDOW}
    """,
)
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ledger_events(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), F.col("seq").cast("string")))
    return ledger.sweep(state, F.lit(SWEEP_NOW), SWEEP_WINDOW)


EXPIRY_WINDOW = 3 * 3600 * 1000

# Every fifth event is an action; some later events change it at once, others after the window,
# the rest change actions that nobody knows.
EXPIRY_LINES = """
    SELECT event_id AS seq, ts, CASE WHEN event_id % 5 = 0 THEN 'action' ELSE 'transition' END AS kind,
           CASE WHEN event_id % 5 = 0 OR event_id % 15 IN (7, 8)
                THEN 'a' || event_id - event_id % 5 - CASE WHEN event_id % 15 = 8 THEN 100 ELSE 0 END
                ELSE 'unknown' || event_id END AS id,
           CASE WHEN event_id % 5 <> 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'passed'
                ELSE 'applied' END AS status
    FROM events
"""


@query(
    "g_expiry_stream",
    f"""
    WITH lines AS ({EXPIRY_LINES})
    SELECT 'transition' AS kind, id, 'final' AS status, '{ledger.EXPIRED}' AS note
    FROM lines a
    WHERE kind = 'action' AND status = 'applied'
      AND ts + INTERVAL {EXPIRY_WINDOW} MILLISECONDS < (SELECT max(date_trunc('milliseconds', ts)) FROM lines)
      AND NOT EXISTS (SELECT 1 FROM lines t WHERE t.kind = 'transition' AND t.id = a.id
                      AND t.ts BETWEEN a.ts AND a.ts + INTERVAL {EXPIRY_WINDOW} MILLISECONDS)
    """,
)
def expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = workspace(spark, "expiry-in"), workspace(spark, "expiry-out")
    key = F.col("event_id")
    owner = key - key % 5 - F.when(key % 15 == 8, 100).otherwise(0)
    status = F.when(key % 5 != 0, "failed").when(key % 3 == 0, "passed").otherwise("applied")
    known = (key % 5 == 0) | (key % 15).isin(7, 8)
    lines = table(spark, sf_dir, "events").select(
        key.alias("seq"),
        F.when(key % 5 == 0, "action").otherwise("transition").alias("kind"),
        F.when(known, F.concat(F.lit("a"), owner.cast("string")))
        .otherwise(F.concat(F.lit("unknown"), key.cast("string"))).alias("id"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
    lines.write.parquet(folder)
    stream = spark.readStream.schema(lines.schema).parquet(folder)
    (
        audit.stream_expiry(stream, EXPIRY_WINDOW)
        .writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", workspace(spark, "expiry-cp"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema("kind string, id string, status string, note string").parquet(out)


# Holds: calls 0 to r-1 of a fingerprint are each released at once, where r comes from its key.
HELD_CALLS = """
    SELECT event_id * 2 AS seq, 'h' || event_id AS id, 'NATION_' || user_id % 25 AS server,
           event_type AS tool, '{"k":' || user_id % 3 || '}' AS args, event_id, (user_id % 4) AS r
    FROM events
"""


def held_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = calls(spark, sf_dir).select(
        (F.col("event_id") * 2).alias("seq"),
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"),
        "server",
        F.col("event_type").alias("tool"),
        F.concat(F.lit('{"k":'), (F.col("user_id") % 3).cast("string"), F.lit("}")).alias("args"),
        (F.col("user_id") % 4).alias("r"),
    )
    ranked = running_sum(found, ["server", "tool", "args", "r"], "seq", F.lit(1), "nth")
    releases = ranked.where("nth <= r").select((F.col("seq") + 1).alias("seq"), "id")
    # The key takes r in as well, so that each fingerprint has one r.
    args = F.concat(F.expr("substring(args, 1, length(args) - 1)"), F.lit(',"r":'), F.col("r").cast("string"), F.lit("}"))
    return ledger.with_fingerprint(found.withColumn("args", args).drop("r")), releases


HOLDS = f"""
    WITH c AS (
      SELECT * REPLACE (rtrim(args, '}}') || ',"r":' || r || '}}' AS args),
             row_number() OVER (PARTITION BY server, tool, args, r ORDER BY seq) AS nth
      FROM ({HELD_CALLS}))
    SELECT seq, id, sha256('["' || server || '","' || tool || '",' || args || ']') AS fp,
           CASE WHEN nth <= r + 1 THEN id
                ELSE max(CASE WHEN nth = r + 1 THEN id END) OVER (PARTITION BY server, tool, args) END AS held_as,
           nth > r + 1 AS repeat
    FROM c
"""


@query("g_dedupe_holds", HOLDS)
def dedupe_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dedupe_holds(*held_calls(spark, sf_dir))


@query("g_holds_stream", HOLDS)
def holds_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = workspace(spark, "holds-in"), workspace(spark, "holds-out")
    found, releases = held_calls(spark, sf_dir)
    events = found.select(F.lit("call").alias("kind"), "*").unionByName(
        releases.select(F.lit("release").alias("kind"), "*"), allowMissingColumns=True
    )
    events = checkpointed(events, "holds-events")
    span, state = events.agg(F.max("seq")).head()[0] + 1, workspace(spark, "holds-cp")
    for part in range(3):
        low, high = span * part // 3, span * (part + 1) // 3
        events.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(folder)
        # All files that came are one batch, written and read by many tasks.
        stream = spark.readStream.schema(events.schema).parquet(folder)
        audit.stream_holds(stream, out, state).awaitTermination()
    return spark.read.parquet(f"{out}/calls").drop("batch_id")


# ---------------------------------------------------------------- paths, budgets, commands


@query(
    "g_paths",
    """
    SELECT page_id, unnest(paths) AS path, generate_subscripts(paths, 1) - 1 AS position
    FROM (SELECT page_id,
                 ['/html/' || page_id, '/in/' || page_id % 7]
                 || CASE WHEN page_id % 3 = 0 THEN ['/third'] ELSE ['/x/' || url] END
                 || ['/deep'] AS paths FROM pages)
    """,
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    lists = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("/third"), F.lit("rel/a"))).otherwise(
        F.array(F.concat(F.lit("/x/"), "url"), F.concat(F.lit("/html/"), key))
    )
    deep = F.struct(F.struct(F.array(F.struct(F.lit("/deep").alias("Profile"))).alias("more")).alias("m"))
    args = F.to_json(
        F.struct(
            F.concat(F.lit("/html/"), key).alias("path"),
            F.col("url").alias("url"),
            F.col("html").alias("content"),
            F.struct(
                F.concat(F.lit("/in/"), (F.col("page_id") % 7).cast("string")).alias("target_file"),
                F.lit("/no/such/key").alias("note"),
                lists.alias("FOLDERS"),
            ).alias("nested"),
            deep.alias("rest"),
        )
    )
    found = argument_paths(table(spark, sf_dir, "pages").select("page_id", args.alias("args")), "page_id")
    return found.select(F.col("id").alias("page_id"), "path", F.col("position").cast("bigint").alias("position"))


BUDGET = 150_000
TIER_SQL = "CASE o_orderstatus WHEN 'P' THEN 'undoable' WHEN 'F' THEN 'pass' ELSE 'hold' END"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    tier = F.when(status == "P", "undoable").when(status == "F", "pass").otherwise("hold")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), tier.alias("tier")
    )


ESCALATED = f"""
    SELECT o_orderkey AS id, CASE WHEN over THEN 'hold' ELSE tier END AS tier,
           CASE WHEN over THEN '{policy.ESCALATED}' END AS note,
           tier = 'undoable' AND NOT over AND coalesce(paths, 0) > 0 AS has_undo
    FROM (SELECT *, tier = 'undoable' AND coalesce(bytes, 0) > {BUDGET} AS over
          FROM (SELECT o_orderkey, {TIER_SQL} AS tier FROM orders)
          LEFT JOIN (SELECT l_orderkey, count(*) AS paths,
                            sum(CASE WHEN l_linenumber = 1 THEN {BUDGET}
                                     ELSE floor(l_extendedprice)::BIGINT END)
                            FILTER (l_returnflag <> 'N') AS bytes
                     FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""


def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first line of an order takes exactly the budget.
    size = F.when(F.col("l_linenumber") == 1, F.lit(BUDGET).cast("bigint")).otherwise(
        F.floor("l_extendedprice")
    )
    sizes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path"),
        (F.col("l_returnflag") != "N").alias("existed"), size.alias("size"),
    )
    return policy.escalate(actions(spark, sf_dir), sizes, BUDGET)


@query("g_escalate", ESCALATED)
def escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalated(spark, sf_dir)


@query(
    "g_initial_status",
    f"""
    SELECT id, tier, CASE tier WHEN 'pass' THEN 'passed' WHEN 'undoable' THEN 'applied'
                               ELSE 'held' END AS status FROM ({ESCALATED})
    """,
)
def initial_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.initial_status(escalated(spark, sf_dir)).select("id", "tier", "status")


# Customers as actions, events as commands for them; tools of nation 7 are gone. Some commits
# come before any undo.
ACTIONS = """
    SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'held' WHEN 1 THEN 'applied'
                                 WHEN 2 THEN 'held' ELSE 'passed' END AS status,
           'NATION_' || c_nationkey AS server, c_mktsegment AS tool,
           c_custkey % 3 <> 0 AS has_undo
    FROM customer
"""
COMMANDS = """
    SELECT event_id AS seq, user_id AS id,
           CASE WHEN event_type IN ('click', 'view') OR event_id < 200 AND user_id % 4 = 0
                THEN 'commit' ELSE 'undo' END AS op,
           CASE WHEN event_type = 'click' THEN 'agent' ELSE 'human' END AS by_whom
    FROM events
"""
WALK = f"""
    WITH RECURSIVE a AS ({ACTIONS}), c AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM ({COMMANDS})),
    walk AS (
      SELECT id, 0::BIGINT AS nth, NULL::BIGINT AS seq, NULL::VARCHAR AS op, false AS accepted, status,
             has_undo, server <> 'NATION_7' AS offered FROM a
      UNION ALL
      SELECT w.id, c.nth, c.seq, c.op, s.next IS NOT NULL, coalesce(s.next, w.status),
             w.has_undo, w.offered
      FROM walk w JOIN c ON c.id = w.id AND c.nth = w.nth + 1,
      LATERAL (SELECT CASE
          WHEN c.op = 'undo' AND w.status = 'held' THEN 'discarded'
          WHEN c.op = 'undo' AND w.status IN ('applied', 'committed') AND w.has_undo THEN 'undone'
          WHEN c.op = 'commit' AND w.status = 'held' AND w.offered AND c.by_whom <> 'agent'
               THEN 'committed' END AS next) s)
"""


def command_inputs(spark: SparkSession, sf_dir: str):
    key = F.col("c_custkey") % 4
    state = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(key == 1, "applied").when(key == 3, "passed").otherwise("held").alias("status"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("server"),
        F.col("c_mktsegment").alias("tool"),
        (F.col("c_custkey") % 3 != 0).alias("has_undo"),
    )
    kind = F.col("event_type")
    early = (F.col("event_id") < 200) & (F.col("user_id") % 4 == 0)
    commands = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
        F.when(kind.isin("click", "view") | early, "commit").otherwise("undo").alias("op"),
        F.when(kind == "click", "agent").otherwise("human").alias("by"),
    )
    tools = state.select("server", "tool").where("server != 'NATION_7'")
    return state, commands, tools


@query(
    "g_commands",
    f"""
    {WALK}
    SELECT c.seq, c.id, c.op, coalesce(w.accepted, false) AS accepted, w.status,
           CASE WHEN w.accepted THEN NULL
                WHEN c.op = 'commit' AND c.by_whom = 'agent' THEN 'agents may not commit'
                WHEN w.status IS NULL THEN 'no such action'
                WHEN c.op = 'commit' AND w.status <> 'held' THEN 'is ' || w.status || ', not held'
                WHEN c.op = 'commit' THEN 'tool no longer available'
                WHEN w.status IN ('applied', 'committed') THEN 'nothing recoverable was captured'
                ELSE 'is ' || w.status || ' and cannot be undone' END AS reason
    FROM c LEFT JOIN walk w ON w.id = c.id AND w.seq = c.seq
    """,
)
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.apply_commands(*command_inputs(spark, sf_dir))


@query(
    "g_command_stream",
    f"{WALK} SELECT id, arg_max(status, nth) AS status FROM walk WHERE id IN (SELECT id FROM c) GROUP BY 1",
)
def command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, sent, tools = command_inputs(spark, sf_dir)
    folder, out = workspace(spark, "commands-in"), workspace(spark, "commands-out")
    for half in (0, 1):
        append_jsonl(sent.where(F.col("seq") % 2 == half), folder)
    schema = "seq bigint, id bigint, op string, by string"
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    audit.stream_commands(lines, out, workspace(spark, "commands-cp")).awaitTermination()
    firsts = current_rows(spark, out, ["id"])
    return ledger.after_commands(state, firsts, tools)


TOOLS = f"SELECT server, tool, min(event_id) AS attach_order FROM ({CALLS}) GROUP BY 1, 2"
EXPOSED = f"""
    SELECT CASE WHEN row_number() OVER (PARTITION BY tool ORDER BY attach_order) = 1 THEN tool
                ELSE server || '__' || tool END AS exposed, server, tool FROM ({TOOLS})
    UNION ALL SELECT 'audit_' || t, NULL, 'audit_' || t
    FROM (SELECT unnest([{sql_list(policy.CONTROL_TOOLS)}]) AS t)
"""


def exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = calls(spark, sf_dir).groupBy("server", "tool").agg(
        F.min("event_id").alias("attach_order")
    )
    return policy.expose_tools(tools)


@query("g_expose_tools", EXPOSED)
def expose_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposed(spark, sf_dir)


ROUTED = f"""
    SELECT event_id, c.name, e.server, e.tool,
           CASE WHEN e.tool IS NULL THEN 'Unknown tool: ' || c.name END AS error
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN tool WHEN 1 THEN server || '__' || tool
                                             ELSE event_type END AS name FROM ({CALLS})) c
    LEFT JOIN ({EXPOSED}) e ON c.name = e.exposed
"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("event_id") % 3
    name = F.when(third == 0, F.col("tool")).when(
        third == 1, F.concat_ws("__", "server", "tool")
    ).otherwise(F.col("event_type"))
    asked = calls(spark, sf_dir).select("event_id", name.alias("name"))
    return policy.route(asked, exposed(spark, sf_dir))


@query("g_route", ROUTED)
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)


@query(
    "g_failures",
    f"""
    SELECT 'transition' AS kind, event_id AS id, event_id % 97 AS ts, 'failed' AS status,
           CASE WHEN event_id % 5 = 0 THEN 'broken ' || event_id
                ELSE 'downstream returned error' END AS note
    FROM ({ROUTED}) WHERE error IS NULL AND (event_id % 5 = 0 OR event_id % 4 = 1)
    """,
)
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    answers = routed(spark, sf_dir).select(
        key.alias("id"), (key % 97).alias("ts"), "error", (key % 4 == 1).alias("is_error"),
        F.when(key % 5 == 0, F.concat(F.lit("broken "), key.cast("string"))).alias("raised"),
    )
    return policy.failures(answers)
