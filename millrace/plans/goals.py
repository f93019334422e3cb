"""Queries on goals, catalogues and the guided run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import goals as words
from millrace.operators import goals
from millrace.plans.common import TABLES, query, sql_list, table
from millrace.plans.profiling import ALL_GUESSES, COLUMNS, stats_sql
from millrace.session import checkpointed

GOALS = """
    SELECT 'd' || doc_id AS id, text AS goal FROM documents
    UNION ALL SELECT 'p' || p_partkey, 'estimate the price of a ' || p_name FROM part
    UNION ALL SELECT 'n' || n_nationkey, 'Please build me a Table model for the ' || n_name FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 'How many  of the LLM' FROM region
"""


def goal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(name: str, prefix: str, key: str, goal) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), key).alias("id"), goal.alias("goal")
        )

    return (
        made("documents", "d", "doc_id", F.col("text"))
        .unionAll(made("part", "p", "p_partkey",
                       F.concat(F.lit("estimate the price of a "), "p_name")))
        .unionAll(made("nation", "n", "n_nationkey",
                       F.concat(F.lit("Please build me a Table model for the "), "n_name")))
        .unionAll(made("region", "r", "r_regionkey", F.lit("How many  of the LLM")))
    )


def _phrases_sql() -> str:
    tests = []
    for task, phrases in words.TASK_PHRASES:
        any_of = " OR ".join(f"contains(t, '{p}')" for p in phrases)
        tests.append(f"WHEN {any_of} THEN '{task}'")
    return f"CASE {' '.join(tests)} ELSE '{words.DEFAULT_TASK}' END"


@query("a_plan_task", f"SELECT id, {_phrases_sql()} AS task FROM (SELECT id, lower(goal) AS t FROM ({GOALS}))")
def plan_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goal_texts(spark, sf_dir).select("id", words.plan_task(F.col("goal")).alias("task"))


KEYWORDS = f"""
    SELECT id, goal, list_filter(regexp_extract_all(lower(goal), '[a-z0-9][a-z0-9-]+'),
                                 lambda w: NOT list_contains([{sql_list(words.STOP_WORDS)}], w))[1:6] AS kw
    FROM ({GOALS})
"""


@query("a_keywords", f"SELECT id, array_to_string(kw, ' ') AS keywords FROM ({KEYWORDS})")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.keywords(F.col("goal"))
    return goal_texts(spark, sf_dir).select("id", F.array_join(found, " ").alias("keywords"))


@query(
    "a_queries",
    f"""
    WITH made AS (
      SELECT id, CASE WHEN len(kw) = 0 THEN [substr(lower(goal), 1, 50)]
                      WHEN len(kw) > 3 THEN [array_to_string(kw[1:3], ' '),
                                             array_to_string(kw[4:6], ' '), kw[1]]
                      ELSE [array_to_string(kw[1:3], ' '), kw[1]] END AS q
      FROM ({KEYWORDS}))
    SELECT id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), '|') AS queries
    FROM made
    """,
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = words.search_queries(F.col("goal"))
    return goal_texts(spark, sf_dir).select("id", F.array_join(made, "|").alias("queries"))


NAME_GOALS = r"""
    SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) || chr(9)
                        ELSE substr(text, 1, (doc_id % 90)::INT) END AS goal FROM documents
    UNION ALL SELECT -1 - doc_id, text FROM documents
"""


@query(
    "a_job_name",
    rf"""
    SELECT doc_id, CASE WHEN length(line) > 60 THEN substr(line, 1, 60) || '…'
                        WHEN line <> '' THEN line ELSE 'autopilot job' END AS name
    FROM (SELECT doc_id, trim(regexp_replace(goal, '[\s\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}]+', ' ', 'g')) AS line
          FROM ({NAME_GOALS}))
    """,
)
def job_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    short = F.when(F.col("doc_id") % 13 == 0, " \n\t").otherwise(
        F.expr("substring(text, 1, CAST(doc_id % 90 AS INT))")
    )
    texts = documents.select("doc_id", short.alias("goal")).unionAll(
        documents.select(-1 - F.col("doc_id"), "text")
    )
    return texts.select("doc_id", words.job_name(F.col("goal")).alias("name"))


REPLY_TASKS = [*words.TASK_NAMES, "other"]


@query(
    "a_parse_plan",
    rf"""
    WITH asked AS (
      SELECT event_id, [{sql_list(REPLY_TASKS)}][event_id % 5 + 1] AS t, event_type AS e,
             user_id AS u FROM events),
    replies AS (
      SELECT event_id, CASE event_id % 7
        WHEN 0 THEN 'Sure: {{"task": "' || t || '", "queries": ["' || e || ' data", "k' || u || '", "c", "d", "e"]}} ok'
        WHEN 1 THEN 'no plan for ' || e
        WHEN 2 THEN '{{"task": "' || t || '", "queries": []}}'
        WHEN 3 THEN '{{"task": "' || t || '", "queries": ["a"'
        WHEN 4 THEN '{{"task": "' || t || '",' || chr(10) || '"queries": ["' || repeat('x', 100) || '", 5]}}'
        WHEN 5 THEN '{{"task": "' || t || '", "queries": ["a"]}} and {{more}}'
        ELSE '["task", "' || t || '"]' END AS reply FROM asked),
    blocks AS (
      SELECT event_id, regexp_extract(reply, '(?s)(\{{.*\}}|\[.*\])', 1) AS block FROM replies),
    plans AS (
      SELECT event_id, CASE WHEN block <> '' AND json_valid(block) THEN block::JSON END AS j
      FROM blocks)
    SELECT event_id, j->>'$.task' AS task,
           array_to_string(list_transform(json_extract(j, '$.queries[*]')[1:4],
                                          lambda q: substr(q->>'$', 1, 80)), '|') AS queries
    FROM plans
    WHERE json_type(j) = 'OBJECT' AND j->>'$.task' IN ({sql_list(words.TASK_NAMES)})
          AND len(json_extract(j, '$.queries[*]')) > 0
    """,
)
def parse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    events = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 7
    t = F.get(F.lit(REPLY_TASKS), (F.col("event_id") % 5).cast("int"))
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    reply = (
        F.when(kind == 0, text('Sure: {"task": "', t, '", "queries": ["', e, ' data", "k', u,
                               '", "c", "d", "e"]} ok'))
        .when(kind == 1, text("no plan for ", e))
        .when(kind == 2, text('{"task": "', t, '", "queries": []}'))
        .when(kind == 3, text('{"task": "', t, '", "queries": ["a"'))
        .when(kind == 4, text('{"task": "', t, '",\n"queries": ["', "x" * 100, '", 5]}'))
        .when(kind == 5, text('{"task": "', t, '", "queries": ["a"]} and {more}'))
        .otherwise(text('["task", "', t, '"]'))
    )
    plans = events.select("event_id", words.parse_plan(reply).alias("plan"))
    return plans.where("plan IS NOT NULL").select(
        "event_id", "plan.task", F.array_join("plan.queries", "|").alias("queries")
    )


# ---------------------------------------------------------------- catalogues

CARDS = """
    SELECT source AS repo_id, sum(n_chars)::BIGINT AS downloads,
           list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1
"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue made from the documents: one card per source, its languages as tags."""
    langs = F.sort_array(F.collect_set("lang"))
    tagged = F.concat(F.array(F.lit("size:any")), "langs")
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("repo_id"))
        .agg(F.sum("n_chars").alias("downloads"), langs.alias("langs"))
        .select("repo_id", "downloads", tagged.alias("tags"))
    )


@query(
    "a_search_cards",
    f"""
    SELECT repo_id, downloads, array_to_string(langs, ',') AS tags FROM ({CARDS})
    WHERE contains(repo_id || ' size:any ' || array_to_string(langs, ' '), 'src1')
          AND contains(repo_id || ' size:any ' || array_to_string(langs, ' '), 'en')
    ORDER BY downloads DESC, repo_id LIMIT 25
    """,
)
def search_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = goals.search_cards(cards(spark, sf_dir), "SRC1 en")
    return found.withColumn("tags", F.array_join("tags", ","))


@query(
    "a_search_many",
    f"""
    WITH cards AS ({CARDS}),
    asked AS (SELECT c_custkey AS q, CASE c_custkey % 4 WHEN 0 THEN 'SRC' || c_nationkey WHEN 1 THEN 'rc' || c_nationkey % 10 || ' en'
                     WHEN 2 THEN c_name ELSE 'e  s' END AS text FROM customer)
    SELECT q AS query, repo_id, downloads FROM asked, cards
    WHERE len(list_filter(string_split(lower(text), ' '),
                          lambda w: NOT contains(repo_id || ' size:any ' || array_to_string(langs, ' '), w))) = 0
    QUALIFY row_number() OVER (PARTITION BY q ORDER BY downloads DESC, repo_id) <= 25
    """,
)
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of every customer against one index of the catalogue."""
    kind, nation = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("SRC"), nation))
        .when(kind == 1, F.concat(F.lit("rc"), (F.col("c_nationkey") % 10).cast("string"), F.lit(" en")))
        .when(kind == 2, F.col("c_name")).otherwise(F.lit("e  s"))
    )
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), text.alias("text"))
    catalogue = cards(spark, sf_dir)
    index = checkpointed(goals.card_index(catalogue), "card-index")
    return goals.search_many(catalogue, asked, index=index).select("query", "repo_id", "downloads")


UNION_QUERIES = ["src1 en", "src2", "en", "nothing"]


@query(
    "a_union_candidates",
    f"""
    WITH cards AS ({CARDS}),
    hits AS (
      SELECT 0 AS q, * FROM cards WHERE contains(repo_id, 'src1') AND list_contains(langs, 'en')
      UNION ALL SELECT 1, * FROM cards WHERE contains(repo_id, 'src2')
      UNION ALL SELECT 2, * FROM cards WHERE list_contains(langs, 'en')),
    ten AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY downloads DESC, repo_id) AS place
            FROM hits QUALIFY place <= 10),
    firsts AS (SELECT * FROM ten QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY q, place) = 1)
    SELECT repo_id, downloads, q AS query, place::INT AS place FROM firsts
    ORDER BY downloads DESC, q, place LIMIT 10
    """,
)
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = goals.union_candidates(cards(spark, sf_dir), UNION_QUERIES)
    return found.select("repo_id", "downloads", "seen.query", "seen.place")


@query(
    "a_rerank",
    """
    WITH ranked AS (
      SELECT c_custkey // 10 AS run, c_name AS repo_id, c_custkey,
             row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_acctbal DESC, c_custkey) - 1 AS position
      FROM customer),
    wanted AS (SELECT * FROM (VALUES (7, 0), (2, 1), (0, 2), (7, 3)) v(old, place))
    SELECT run, repo_id,
           (row_number() OVER (PARTITION BY run ORDER BY place NULLS LAST, position) - 1)::INT AS position
    FROM ranked LEFT JOIN (SELECT old, min(place) AS place FROM wanted GROUP BY 1) ON old = position
    """,
)
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs of ten candidates each, as a search leaves them.
    best = Window.partitionBy("run").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    lists = (
        table(spark, sf_dir, "customer")
        .withColumn("run", F.expr("c_custkey div 10"))
        .withColumn("position", F.row_number().over(best) - 1)
        .select("run", F.col("c_name").alias("repo_id"), "position")
    )
    # The order asked for: old places 7, 2, 0 and 7 again, and an id no list has.
    place = F.when(F.col("position") == 7, F.array(F.lit(0), F.lit(3))).when(
        F.col("position") == 2, F.array(F.lit(1))
    ).when(F.col("position") == 0, F.array(F.lit(2)))
    order = lists.select("run", "repo_id", F.explode(place).alias("place"))
    unknown = lists.select("run", F.lit("unknown").alias("repo_id"), F.lit(0).alias("place"))
    return goals.rerank(lists, order.unionByName(unknown.distinct()))


CANDIDATES = ["absent", "pages", "labels", "documents", "customer"]


@query(
    "a_first_fit",
    f"""
    WITH tried AS (
      SELECT g.*, s.n, s.kind, list_position([{sql_list(CANDIDATES[:4])}], g."table") AS place
      FROM ({ALL_GUESSES}) g
      LEFT JOIN ({" UNION ALL ".join(f"SELECT '{n}' AS tab, * FROM ({stats_sql(n)})" for n in TABLES)}) s
        ON s.tab = g."table" AND s.col = g.label_column),
    fits AS (
      SELECT task, "table", place FROM tried,
             (SELECT unnest([{sql_list(words.TASK_NAMES)}]) AS task)
      WHERE place IS NOT NULL AND CASE task
            WHEN 'text-classification' THEN text_column IS NOT NULL AND n BETWEEN 2 AND 100
            WHEN 'causal-lm' THEN text_column IS NOT NULL
            WHEN 'tabular-classification' THEN label_column IS NOT NULL AND n_columns >= 2
            ELSE label_column IS NOT NULL AND n_columns >= 2 AND kind = 'N' END)
    SELECT task, arg_min("table", place) AS repo_id, (min(place) - 1)::BIGINT AS n_rejected
    FROM fits GROUP BY 1
    """,
)
def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for task in words.TASK_NAMES:
        choice = goals.first_fit(task, CANDIDATES, lambda n: table(spark, sf_dir, n))
        if choice.repo_id:
            rows.append((task, choice.repo_id, len(choice.rejected)))
    return spark.createDataFrame(rows, "task string, repo_id string, n_rejected bigint")


# ---------------------------------------------------------------- the whole run


def table_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of the given tables: rows as downloads, column names as tags."""
    rows = []
    for name in TABLES:
        tags = [c.strip().split(" ")[1] for c in COLUMNS[name].split(",")]
        rows.append((name, table(spark, sf_dir, name).count(), 0, tags, ""))
    return spark.createDataFrame(
        rows,
        "repo_id string, downloads bigint, likes bigint, tags array<string>, last_modified string",
    )


GOAL = "Build a model that can predict customer churn from our table"


def guided_run(spark: SparkSession, sf_dir: str) -> goals.Run:
    return goals.autopilot(
        spark,
        GOAL,
        table_cards(spark, sf_dir),
        lambda name: table(spark, sf_dir, name),
        max_rows=None,
        hp={"n_estimators": 10, "max_depth": 5},
    )


@query("a_autopilot")
def autopilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a run from a goal in plain words to a trained model, over whole tables."""
    run = guided_run(spark, sf_dir)
    if run.error:
        raise RuntimeError(run.error)
    return run.steps
