"""Queries on sources, sinks and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ordered import running_sum
from millrace.functions.text import format_name, source_name, suffix
from millrace.plans.common import query, table
from millrace.session import workspace
from millrace.sources import datasets, jsonlines, tables
from millrace.sources.logtail import append_lines
from millrace.streaming.logs import poll_logs, tail_logs


@query("s_read_csv", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csv")
    table(spark, sf_dir, "region").write.option("header", True).csv(path)
    return tables.read_table(spark, path, "csv")


@query(
    "s_read_csv_types",
    """
    SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size,
           CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price,
           CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS p_type,
           '90000000000000000000' || lpad(p_partkey::VARCHAR, 12, '0') AS wide,
           p_size > 25 AS large, p_name || ', "' || p_brand || '"' AS quoted
    FROM part
    """,
)
def read_csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csv-types")
    missing = F.lit("N/A")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        "p_brand",
        "p_size",
        F.when(F.col("p_partkey") % 7 == 0, "NaN")
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("price"),
        F.when(F.col("p_partkey") % 5 == 0, missing).otherwise(F.col("p_type")).alias("p_type"),
        F.concat(F.lit("9" + "0" * 19), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("wide"),
        (F.col("p_size") > 25).alias("large"),
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("quoted"),
    )
    part.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, path, "csv")


NATION_LONG = """
    SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey
    FROM nation
"""


@query("s_read_tsv", NATION_LONG)
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "tsv")
    table(spark, sf_dir, "nation").write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_table(spark, path, "tsv")


@query(
    "s_read_parquet",
    "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders",
)
def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.read_table(spark, f"{sf_dir}/orders.parquet")
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "s_read_jsonl",
    "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier",
)
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "jsonl")
    table(spark, sf_dir, "supplier").write.json(path)
    return tables.read_table(spark, path, "jsonl")


@query("s_read_json_array", NATION_LONG)
def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "json-array")
    # Documents of ten records per file, and one file with a record per line.
    nation = table(spark, sf_dir, "nation")
    documents = (
        nation.where("n_nationkey < 20")
        .groupBy(F.floor(F.col("n_nationkey") / 10).alias("part"))
        .agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("d"))
    )
    documents.write.partitionBy("part").text(path)
    nation.where("n_nationkey >= 20").coalesce(1).write.json(f"{path}/lines")
    return tables.read_table(spark, f"{path}/*", "json").drop("part")


@query("s_read_json_fallback", NATION_LONG)
def read_json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "json-lines")
    table(spark, sf_dir, "nation").write.json(path)
    return tables.read_table(spark, path, "json")


@query(
    "s_format_of",
    r"""
    WITH names AS (
      SELECT page_id,
             regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*', '') AS path
      FROM pages),
    parts AS (
      SELECT page_id,
             CASE WHEN rtrim(path, '/') = '' THEN 'download'
                  ELSE list_extract(string_split(rtrim(path, '/'), '/'), -1) END AS name
      FROM names),
    kinds AS (
      SELECT *, lower(regexp_extract(name, '[^.].*?(\.[^./]+)$', 1)) AS suffix FROM parts)
    SELECT page_id, name, suffix,
           CASE WHEN suffix IN ('.csv', '.txt', '') THEN 'csv' WHEN suffix = '.tsv' THEN 'tsv'
                WHEN suffix = '.parquet' THEN 'parquet' WHEN suffix = '.jsonl' THEN 'jsonl'
                WHEN suffix = '.json' THEN 'json' END AS format
    FROM kinds
    """,
)
def format_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").select("page_id", source_name(F.col("url")).alias("name"))
    name = F.col("name")
    return named.select(
        "page_id", "name", suffix(name).alias("suffix"), format_name(name).alias("format")
    )


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "s_capped_import",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem ORDER BY {', '.join(LINE_ORDER)} LIMIT 5000
    """,
)
def capped_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/lineitem.parquet"
    return tables.import_table(spark, path, tables.DEFAULT_MAX_ROWS, LINE_ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


@query(
    "s_finalize",
    """
    WITH counts AS (
      SELECT count(*) AS n, count(DISTINCT p_partkey) AS a, count(DISTINCT p_name) AS b,
             count(DISTINCT p_brand) AS c, count(DISTINCT p_type) AS d,
             count(DISTINCT p_size) AS e, count(DISTINCT p_retailprice) AS f FROM part)
    SELECT 'part' AS name, 'ready' AS status, n AS num_rows, true AS has_bytes,
           unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS col,
           unnest([least(a, 1000), least(b, 1000), least(c, 1000), least(d, 1000),
                   least(e, 1000), least(f, 1000)]) AS n_unique
    FROM counts
    """,
)
def finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = workspace(spark, "part")
    row = datasets.finalize(table(spark, sf_dir, "part"), out, "part", "part.parquet", "p_partkey")
    return row.select(
        "name", "status", "num_rows", (F.col("size_bytes") > 0).alias("has_bytes"),
        F.explode("columns").alias("c"),
    ).select("name", "status", "num_rows", "has_bytes", F.col("c.name").alias("col"), "c.n_unique")


@query("s_names", 'SELECT r_regionkey AS "0", r_name AS "Region name" FROM region')
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.normalize_names(table(spark, sf_dir, "region").toDF("0", "Region name"))


@query(
    "s_coerce_nested",
    """
    SELECT vec_id, label, u.pos::BIGINT AS pos, round(u.x::DOUBLE, 6) AS x
    FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos
          FROM embeddings) u
    """,
)
def coerce_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tables.coerce_nested(table(spark, sf_dir, "embeddings"))
    parsed = F.from_json("embedding", "array<float>")
    return flat.select("vec_id", "label", F.posexplode(parsed).alias("pos", "v")).select(
        "vec_id", "label", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("v").cast("double"), 6).alias("x"),
    )


@query(
    "s_import_many",
    """
    SELECT * FROM (
      SELECT 'customer' AS name, 'ready' AS status, count(*) AS num_rows, false AS has_error FROM customer
      UNION ALL SELECT 'supplier', 'ready', count(*), false FROM supplier
      UNION ALL SELECT 'first orders', 'ready', least(count(*), 100), false FROM orders
      UNION ALL SELECT 'no such file', 'failed', NULL, true
      UNION ALL SELECT 'bad suffix', 'failed', NULL, true)
    """,
)
def import_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        {"name": "customer", "path": f"{sf_dir}/customer.parquet", "order_by": "c_custkey"},
        {"name": "supplier", "path": f"{sf_dir}/supplier.parquet", "order_by": "s_suppkey"},
        {"name": "first orders", "path": f"{sf_dir}/orders.parquet", "order_by": "o_orderkey",
         "max_rows": 100},
        {"name": "no such file", "path": f"{sf_dir}/missing.parquet"},
        {"name": "bad suffix", "path": f"{sf_dir}/customer.docx"},
    ]
    done = datasets.import_many(spark, specs, workspace(spark, "imports"))
    return done.select("name", "status", "num_rows", F.col("error").isNotNull().alias("has_error"))


EVENT_POINTS = """
    SELECT event_id AS seq, user_id % 20 AS job, event_id % 1000 AS step, event_type AS key, value
    FROM events
"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as metric points: 20 jobs, the event type as the name of the metric."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 20).alias("job"),
        (F.col("event_id") % 1000).alias("step"),
        F.col("event_type").alias("key"),
        "value",
    )


def stored_points(spark: SparkSession, sf_dir: str, torn: bool = True) -> str:
    """Folder of metric lines made from the events, with blank and torn lines in between."""
    folder = workspace(spark, "points")
    points = event_points(spark, sf_dir).select(
        "seq", "job", "step", F.create_map("key", "value").alias("metrics")
    )
    lines = points.select("seq", F.to_json(F.struct(*points.columns)).alias("line"))
    if torn:
        # Every 50th line is followed by a blank one and by one cut off in a write.
        cut = F.expr("substring(line, 1, length(line) - 5)")
        extra = F.when(F.col("seq") % 50 == 0, F.array("line", F.lit(""), cut))
        lines = lines.select(F.explode(F.coalesce(extra, F.array("line"))).alias("line"))
    lines.select("line").write.text(folder)
    return folder


@query(
    "s_metrics_stream",
    f"SELECT job, key, count(*) AS points, round(sum(value), 4) AS total FROM ({EVENT_POINTS}) GROUP BY ALL",
)
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stored_points(spark, sf_dir)
    out = workspace(spark, "points-out")
    points = jsonlines.read_metrics(spark, folder, stream=True, max_files=2)
    flat = points.where("job IS NOT NULL").select(
        "job", F.explode("metrics").alias("key", "value")
    )
    jsonlines.append_stream(flat, out, workspace(spark, "points-cp")).awaitTermination()
    return (
        spark.read.schema(flat.schema).json(out).groupBy("job", "key")
        .agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"))
    )


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job logs made from the events: consecutive byte ranges per job."""
    lines = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("job"), "event_id",
        F.concat_ws(" ", "event_type", "props").alias("line"),
    ).withColumn("data", F.concat("line", F.lit("\n")).cast("binary"))
    ends = running_sum(lines, ["job"], "event_id", F.octet_length("data").cast("bigint"), "end")
    return ends.select("job", (F.col("end") - F.octet_length("data")).alias("start"), "data")


@query(
    "s_log_poll",
    """
    WITH logs AS (
      SELECT user_id % 20 AS job,
             string_agg(event_type || ' ' || props || chr(10), '' ORDER BY event_id) AS log
      FROM events GROUP BY 1),
    polls AS (SELECT DISTINCT user_id % 20 AS job, event_id * 7 - 100 AS "offset" FROM events),
    placed AS (
      SELECT p.job, p."offset", log, length(log) AS size,
             greatest(0, least(p."offset", length(log))) AS pos
      FROM polls p JOIN logs USING (job))
    SELECT job, "offset", substr(log, pos + 1, 1000) AS content,
           pos + length(substr(log, pos + 1, 1000)) AS next_offset, size FROM placed
    """,
)
def log_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("job"), (F.col("event_id") * 7 - 100).alias("offset")
    )
    return poll_logs(event_chunks(spark, sf_dir), polls, 1000)


@query(
    "s_log_tail",
    """
    SELECT user_id % 20 AS job, event_type || ' ' || props AS line,
           sum(octet_length(encode(event_type || ' ' || props)) + 1) OVER (
             PARTITION BY user_id % 20 ORDER BY event_id % 2, event_id
           )::BIGINT - octet_length(encode(event_type || ' ' || props)) - 1 AS start
    FROM events
    """,
)
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, out = workspace(spark, "log"), workspace(spark, "log-out")
    checkpoint = workspace(spark, "log-cp")
    lines = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("job-"), F.col("user_id") % 20, F.lit("/job.log")).alias("file"),
        F.concat_ws(" ", "event_type", "props").alias("line"),
    )
    # The same files grow between two runs of one query; the second reads only what was added.
    for half in (0, 1):
        append_lines(lines.where(F.col("event_id") % 2 == half), folder, "file", "event_id", "line")
        tail = tail_logs(spark, folder)
        running = (
            tail.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .option("path", out).start()
        )
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    job = F.regexp_extract("file", r"^job-(\d+)/", 1).cast("bigint")
    return spark.read.schema(tail.schema).parquet(out).select(job.alias("job"), "line", "start")


@query("s_list_files", "SELECT DISTINCT o_orderstatus AS status, true AS has_bytes FROM orders")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "artifact")
    table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(folder)
    status = F.regexp_extract("file", "^o_orderstatus=([A-Z])/part-", 1)
    return datasets.list_files(spark, folder).groupBy(status.alias("status")).agg(
        (F.min("length") > 0).alias("has_bytes")
    )


@query(
    "s_append_jsonl",
    f"""
    SELECT job, count(*) AS lines, count(DISTINCT seq) AS points, round(sum(value), 4) AS total,
           round(max(epoch), 3) AS epoch, true AS has_time
    FROM (SELECT *, round(value / 7, 3) AS epoch FROM ({EVENT_POINTS}))
    GROUP BY job
    """,
)
def append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "appended")
    points = event_points(spark, sf_dir).withColumn("epoch", F.col("value") / 7)
    for half in (0, 1):
        stored = jsonlines.metric_points(points.where(F.col("seq") % 2 == half))
        jsonlines.append_jsonl(stored, folder)
    schema = "time double, job bigint, seq bigint, step bigint, epoch double, value double"
    return jsonlines.read_metrics(spark, folder, schema=schema).groupBy("job").agg(
        F.count("*").alias("lines"),
        F.count_distinct("seq").alias("points"),
        F.round(F.sum("value"), 4).alias("total"),
        F.round(F.max("epoch"), 3).alias("epoch"),
        (F.count("time") == F.count("*")).alias("has_time"),
    )
