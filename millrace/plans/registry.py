"""Queries on registry tables and training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.goals import TASK_NAMES
from millrace.operators import metrics, registry, tasks
from millrace.plans.common import nulled, query, sql_list, table
from millrace.plans.ingest import EVENT_POINTS, event_points, stored_points
from millrace.session import workspace
from millrace.sources.jsonlines import read_metrics
from millrace.streaming.logs import stream_latest
from millrace.streaming.tables import current_rows


@query("r_newest", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return registry.newest(
        orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    )


@query("r_newest_top", "SELECT o_orderkey AS id FROM orders ORDER BY 1 DESC LIMIT 50")
def newest_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return registry.newest(orders.select(F.col("o_orderkey").alias("id")), 50)


@query("r_by_id", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return registry.by_id(orders, 77, "o_orderkey")


FIELDS = ["click", "view", "purchase", "signup"]


@query(
    "r_fold_updates",
    f"""
    SELECT user_id AS id, {', '.join(
        f"arg_max_null(v, event_id) FILTER (event_type = '{f}') AS {f}" for f in FIELDS)}
    FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN value END AS v FROM events) GROUP BY 1
    """,
)
def fold_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("field"), nulled("event_id", 9, "value").alias("value"),
    )
    return registry.fold_updates(log, FIELDS)


# Every second user's errors delete the row; a signup sets the status.
@query(
    "r_fold_deletes",
    """
    WITH log AS (
      SELECT user_id AS id, event_id AS seq, event_type AS field,
             event_type = 'error' AND user_id % 2 = 0 AS deletes,
             CASE WHEN event_type = 'signup' THEN
                       CASE WHEN event_id % 50 = 0 THEN 'done' ELSE 'running' END
                  ELSE value::VARCHAR END AS value
      FROM events),
    seen AS (
      SELECT *, last_value(CASE WHEN field = 'signup' THEN value END IGNORE NULLS)
                OVER (PARTITION BY id ORDER BY seq) AS status FROM log),
    gone AS (SELECT DISTINCT id FROM seen WHERE deletes AND status IS DISTINCT FROM 'running')
    SELECT id, arg_max(value, seq) FILTER (field = 'signup') AS signup,
           arg_max(value, seq) FILTER (field = 'click') AS click
    FROM log WHERE NOT deletes AND id NOT IN (SELECT id FROM gone) GROUP BY 1
    """,
)
def fold_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deletes = (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)
    state = F.when(F.col("event_id") % 50 == 0, "done").otherwise("running")
    value = F.when(F.col("event_type") == "signup", state).otherwise(F.col("value").cast("string"))
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("field"),
        F.when(deletes, "delete").otherwise("update").alias("op"), value.alias("value"),
    )
    return registry.fold_deletes(log, ["signup", "click"], status="signup")


@query(
    "r_reconcile",
    f"""
    SELECT o_orderkey AS id, o_custkey AS pid,
           CASE WHEN dead THEN 'failed' ELSE status END AS status,
           CASE WHEN dead THEN '{registry.DEAD_WORKER}' END AS error,
           CASE WHEN dead THEN 1000.0::DOUBLE END AS finished_at
    FROM (SELECT *, status = 'running' AND o_custkey <> 0
                    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS dead
          FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'succeeded' END AS status
                FROM orders))
    """,
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pid"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("finished_at"),
    )
    alive = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("pid")
    )
    return registry.reconcile(jobs, alive, F.lit(1000.0))


@query(
    "r_validate_jobs",
    f"""
    SELECT l_orderkey AS dataset_id, l_linenumber, l_partkey,
           CASE WHEN status IS NULL THEN 404 WHEN status <> 'ready' THEN 409 ELSE 202 END AS code,
           CASE WHEN status IS NULL THEN '{registry.MISSING_DATASET}'
                WHEN status <> 'ready' THEN '{registry.DATASET_NOT_READY}' END AS detail
    FROM lineitem LEFT JOIN (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'importing' END AS status
      FROM orders WHERE o_orderkey % 10 <> 0) ON l_orderkey = o_orderkey
    """,
)
def validate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"), "l_linenumber", "l_partkey"
    )
    datasets = table(spark, sf_dir, "orders").where("o_orderkey % 10 != 0").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "ready").otherwise("importing").alias("status"),
    )
    return registry.validate_jobs(requests, datasets)


@query(
    "r_register",
    """
    SELECT o_orderkey AS job_id, o_orderpriority AS name, 'tabular-regression' AS task,
           NULL::VARCHAR AS base_model, o_totalprice AS metrics
    FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0
    """,
)
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
        F.lit("tabular-regression").alias("task"), F.lit(None).cast("string").alias("base_model"),
        F.col("o_totalprice").alias("metrics"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
    )
    models = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("job_id"))
    return registry.register_models(jobs, models)


@query(
    "r_lineage",
    """
    SELECT l_orderkey AS job_id, l_linenumber, l_partkey, o_orderpriority AS job_name,
           o_custkey AS dataset_id, c_name AS dataset_name
    FROM lineitem
    LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey
    """,
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey"
    )
    jobs = table(spark, sf_dir, "orders").where("o_orderkey % 5 != 0").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
        F.col("o_custkey").alias("dataset_id"),
    )
    datasets = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return registry.lineage(models, jobs, datasets)


@query(
    "r_duration",
    """
    SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN
             greatest(0, floor(CASE WHEN event_id % 7 = 0 THEN 50000.0 ELSE event_id * 3.5 END
                               - value * 10 + 0.5))::BIGINT END AS seconds
    FROM events
    """,
)
def duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 != 0, F.col("value") * 10).alias("started_at"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") * 3.5).alias("finished_at"),
    )
    return registry.with_duration(runs, F.lit(50000.0)).select("event_id", "seconds")


@query(
    "r_steps",
    """
    SELECT event_id AS run_id, pos::INT AS position,
           CASE pos WHEN 0 THEN event_type ELSE 'Launched' END AS title,
           CASE pos WHEN 0 THEN props ELSE user_id::VARCHAR END AS detail,
           CASE WHEN pos = 1 AND event_type NOT IN ('click', 'view') THEN 'done'
                WHEN pos = 1 THEN 'running' ELSE 'done' END AS status
    FROM events, (SELECT unnest([0, 1]) AS pos) WHERE pos = 0 OR event_id % 3 <> 0
    """,
)
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(title, detail, status):
        return F.struct(
            title.alias("title"), detail.alias("detail"), F.lit(status).alias("status")
        )

    first = step(F.col("event_type"), F.col("props"), "done")
    second = step(F.lit("Launched"), F.col("user_id").cast("string"), "running")
    ended = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("click", "view"), "running").otherwise(ended).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.array(first)).otherwise(F.array(first, second)).alias("steps"),
    )
    return registry.explode_steps(runs)


def _spec_sql() -> str:
    rows = [
        f"('{t.name}', '{p.name}', '{p.type}', '{tasks._text(p.default)}')"
        for t in (tasks.TASKS[n] for n in TASK_NAMES)
        for p in t.params
    ]
    return f"(VALUES {', '.join(rows)}) AS spec(task, name, type, dflt)"


@query(
    "r_merge_hp",
    f"""
    WITH jobs AS (
      SELECT event_id AS job, [{sql_list(TASK_NAMES)}][event_id % 4 + 1] AS task,
             {{'n_estimators': user_id::VARCHAR, 'max_depth': '3.7', 'seed': '',
               'test_size': value::VARCHAR, 'eval_fraction': event_type, 'label_column': event_type,
               'max_length': ' ' || user_id || ' ',
               'merge_adapter': ['Yes', 'off', ''][event_id % 3 + 1]}} AS v
      FROM events),
    given AS (
      SELECT job, spec.task, name, type, dflt, CASE name
        WHEN 'n_estimators' THEN v.n_estimators WHEN 'max_depth' THEN v.max_depth
        WHEN 'seed' THEN v.seed WHEN 'test_size' THEN v.test_size
        WHEN 'eval_fraction' THEN v.eval_fraction WHEN 'label_column' THEN v.label_column
        WHEN 'max_length' THEN v.max_length
        WHEN 'merge_adapter' THEN v.merge_adapter END AS g
      FROM jobs JOIN {_spec_sql()} ON jobs.task = spec.task)
    SELECT job, task, name,
           CASE WHEN type <> 'float' THEN
             CASE WHEN type = 'int' AND regexp_matches(g, '^\\s*[0-9]+\\s*$') THEN trim(g)
                  WHEN type = 'bool' AND g <> '' THEN (g = 'Yes')::VARCHAR
                  WHEN type = 'str' AND g <> '' THEN g ELSE dflt END END AS value,
           CASE WHEN type = 'float' THEN round(coalesce(TRY_CAST(g AS DOUBLE), dflt::DOUBLE), 6) END AS number
    FROM given
    """,
)
def merge_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tasks.specs(spark, TASK_NAMES)
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    values = {
        "n_estimators": user, "max_depth": F.lit("3.7"), "seed": F.lit(""),
        "test_size": F.col("value").cast("string"), "eval_fraction": kind, "label_column": kind,
        "max_length": F.concat(F.lit(" "), user, F.lit(" ")), "unheard_of": kind,
        "merge_adapter": F.get(F.array(F.lit("Yes"), F.lit("off"), F.lit("")), (F.col("event_id") % 3).cast("int")),
    }
    pairs = [c for k, v in values.items() for c in (F.lit(k), v)]
    jobs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job"),
        F.get(F.lit(list(TASK_NAMES)), (F.col("event_id") % 4).cast("int")).alias("task"),
        F.create_map(*pairs).alias("values"),
    )
    merged = registry.merge_hyperparams(spec, jobs).join(
        spec.select("task", "name", "type"), ["task", "name"]
    )
    real = F.col("type") == "float"
    return merged.select(
        "job", "task", "name",
        F.when(~real, F.col("value")).alias("value"),
        F.when(real, F.round(F.col("value").try_cast("double"), 6)).alias("number"),
    )


@query(
    "r_task_catalog",
    """
    WITH installed AS (SELECT DISTINCT p_name FROM part WHERE p_size = 50 AND p_partkey % 2 = 0),
    wanted AS (SELECT DISTINCT p_brand AS task, p_name FROM part),
    lacking AS (SELECT task, list_sort(list(p_name)) AS names FROM wanted
                WHERE p_name NOT IN (SELECT p_name FROM installed) GROUP BY 1)
    SELECT task, names IS NULL AS available,
           coalesce(array_to_string(names, ','), '') AS missing_requirements
    FROM (SELECT DISTINCT task FROM wanted) LEFT JOIN lacking USING (task)
    """,
)
def task_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_brand").alias("task"), F.col("p_name").alias("capability"))
    installed = part.where("p_size = 50 AND p_partkey % 2 = 0").select(
        F.col("p_name").alias("capability")
    )
    return registry.task_catalog(wanted, installed)


@query(
    "r_lacking",
    """
    SELECT DISTINCT p_brand AS task, p_name AS capability FROM part
    WHERE p_partkey % 5 <> 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50 AND p_partkey % 2 = 0)
    """,
)
def lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = part.select(F.col("p_brand").alias("task"), nulled("p_partkey", 5, "p_name").alias("capability"))
    installed = part.where("p_size = 50 AND p_partkey % 2 = 0").select(F.col("p_name").alias("capability"))
    return registry.lacking(wanted, installed)


# ---------------------------------------------------------------- metrics


@query(
    "m_loss_series",
    """
    SELECT event_id AS seq, user_id % 20 AS job,
           CASE event_type WHEN 'click' THEN 'loss' ELSE 'eval_loss' END AS series,
           CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 ELSE 0 END AS x, value AS y
    FROM events WHERE event_type IN ('click', 'view')
    """,
)
def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_points(spark, sf_dir).select(
        "seq", "job", nulled("seq", 4, "step").alias("step"),
        F.when(F.col("key") == "click", F.col("value")).alias("loss"),
        F.when(F.col("key") == "view", F.col("value")).alias("eval_loss"),
    )
    return metrics.loss_series(points, ["seq", "job"])


LATEST = f"""
    SELECT job, key, arg_max(value, seq) AS value, min(seq) AS first_seq
    FROM (SELECT * REPLACE (CASE key WHEN 'click' THEN 'loss' ELSE key END AS key) FROM ({EVENT_POINTS}))
    WHERE key NOT IN ('time', 'step', 'loss', 'eval_loss') GROUP BY 1, 2
"""


def metric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir).select(
        "seq", "job", F.when(F.col("key") == "click", "loss").otherwise(F.col("key")).alias("key"),
        "value",
    )


@query("m_latest", LATEST)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_metrics(metric_entries(spark, sf_dir))


@query("m_latest_stream", LATEST.replace("CASE key WHEN 'click' THEN 'loss' ELSE key END", "key"))
def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stored_points(spark, sf_dir)
    points = read_metrics(spark, folder, stream=True, max_files=1).where("job IS NOT NULL")
    out = workspace(spark, "latest")
    entries = metrics.metric_entries(points)
    stream_latest(entries, out, workspace(spark, "latest-cp")).awaitTermination()
    return current_rows(spark, out, ["job", "key"])


@query(
    "m_tiles",
    f"""
    WITH latest AS ({LATEST}),
    final AS (
      SELECT job, 'best_' || key AS key, max(value) AS value, 1 AS position
      FROM ({EVENT_POINTS}) GROUP BY 1, 2
      UNION ALL SELECT job, key, CASE WHEN job % 3 <> 0 THEN min(value) END, 0
      FROM ({EVENT_POINTS}) WHERE key = 'view' GROUP BY 1, 2),
    both_ AS (
      SELECT coalesce(l.job, f.job) AS job, coalesce(l.key, f.key) AS key, first_seq, position,
             CASE WHEN f.job IS NOT NULL THEN f.value ELSE l.value END AS value
      FROM latest l FULL JOIN final f ON l.job = f.job AND l.key = f.key)
    SELECT job, key, value,
           row_number() OVER (PARTITION BY job ORDER BY first_seq NULLS LAST, position, key)::INT AS tile
    FROM both_ WHERE value IS NOT NULL QUALIFY tile <= 8
    """,
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_points(spark, sf_dir)
    best = points.groupBy("job", F.concat(F.lit("best_"), "key").alias("key")).agg(
        F.max("value").alias("value")
    )
    view = points.where("key = 'view'").groupBy("job", "key").agg(F.min("value").alias("value"))
    final = best.withColumn("position", F.lit(1)).unionByName(
        view.withColumn("value", nulled("job", 3, "value")).withColumn("position", F.lit(0))
    )
    return metrics.metric_tiles(metrics.latest_metrics(metric_entries(spark, sf_dir)), final)


@query(
    "m_nearest",
    """
    WITH wanted AS (SELECT DISTINCT user_id AS series, event_id AS step FROM events
                    WHERE event_type = 'error'),
    points AS (SELECT user_id AS series, event_id AS step, value AS y FROM events
               WHERE event_type = 'click')
    SELECT w.series, w.step, p.step AS near_step, p.y AS near_y
    FROM wanted w JOIN points p ON w.series = p.series
    QUALIFY row_number() OVER (PARTITION BY w.series, w.step
                               ORDER BY abs(p.step - w.step), p.step) = 1
    """,
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").alias("step"),
        F.col("value").alias("y"), "event_type",
    )
    wanted = events.where("event_type = 'error'").select("series", "step")
    points = events.where("event_type = 'click'").select("series", "step", "y")
    return metrics.nearest_step(wanted, points)
