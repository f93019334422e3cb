"""Queries on profiles, guesses and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import filters, profile
from millrace.operators.filters import check_fit
from millrace.functions.goals import TASK_NAMES
from millrace.plans.common import TABLES, nulled, query, table
from millrace.session import side_by_side

# Columns of the given tables in order, with T for text and N for other flat columns.
COLUMNS = {
    "region": "N r_regionkey, T r_name",
    "nation": "N n_nationkey, T n_name, N n_regionkey",
    "customer": "N c_custkey, T c_name, N c_nationkey, N c_acctbal, T c_mktsegment",
    "supplier": "N s_suppkey, T s_name, N s_nationkey, N s_acctbal",
    "part": "N p_partkey, T p_name, T p_brand, T p_type, N p_size, N p_retailprice",
    "orders": "N o_orderkey, N o_custkey, T o_orderstatus, N o_totalprice, D o_orderdate, "
    "T o_orderpriority",
    "lineitem": "N l_orderkey, N l_partkey, N l_suppkey, N l_linenumber, N l_quantity, "
    "N l_extendedprice, N l_discount, N l_tax, T l_returnflag, T l_linestatus, D l_shipdate",
    "events": "N event_id, D ts, N user_id, T event_type, N value, T props",
    "documents": "N doc_id, T text, T lang, T source, N n_chars",
    "embeddings": "N vec_id, X embedding, N label",
    "pages": "N page_id, T url, T html",
    "benchmark": "N item_id, T text",
    "labels": "N doc_id, N quality, N toxic",
    "conversations": "N conv_id, N turn, T role, T text",
}


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in COLUMNS[name].split(",")]


def stats_sql(name: str) -> str:
    """Distinct counts and mean text lengths of a table's columns, one row each."""
    parts = []
    for i, (kind, column) in enumerate(columns_of(name)):
        count = "max(NULL)" if kind == "X" else f"count(DISTINCT {column})"
        length = f"avg(length({column}))" if kind == "T" else "max(NULL)"
        parts.append(
            f"SELECT {i} AS i, '{column}' AS col, '{kind}' AS kind, {count}::BIGINT AS n, "
            f"{length}::DOUBLE AS len FROM {name}"
        )
    return " UNION ALL ".join(parts)


def _first_of(names) -> str:
    """Rank of a column name in a preference list, null if it is not in it."""
    places = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    return f"CASE lower(col) {places} END"


TEXT_SQL = f"""
    coalesce(arg_min(col, {_first_of(profile.TEXT_NAMES)}),
             arg_max(col, (len, -i)) FILTER (kind = 'T' AND len > 0))
"""


def guess_sql(name: str) -> str:
    """Guessed text and label column of a table."""
    return f"""
    SELECT '{name}' AS "table", max(text) AS text_column,
           coalesce(arg_min(col, {_first_of(profile.LABEL_NAMES)}),
                    arg_min(col, (n, i)) FILTER (n BETWEEN 2 AND 100
                                                 AND col IS DISTINCT FROM text)) AS label_column,
           count(*) AS n_columns
    FROM (SELECT s.*, t.text FROM ({stats_sql(name)}) s,
                 (SELECT {TEXT_SQL} AS text FROM ({stats_sql(name)})) t)
    """


ALL_GUESSES = " UNION ALL ".join(guess_sql(n) for n in TABLES)


def all_stats(spark: SparkSession, sf_dir: str) -> dict:
    found = side_by_side(spark, lambda n: profile.column_stats(table(spark, sf_dir, n)), TABLES)
    return dict(zip(TABLES, found, strict=True))


#: Names of column types in SQL and in Spark.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>",
}


def profile_sql(name: str) -> str:
    kinds = " UNION ALL ".join(f"SELECT '{c}' AS col, any_value(typeof({c})) AS kind FROM {name}" for _, c in columns_of(name))
    types = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
    return f"""
    SELECT s.col AS name, CASE t.kind {types} END AS dtype,
           CASE WHEN n IS NOT NULL THEN least(n, 1000) END AS n_unique, coalesce(n >= 1000, false) AS unique_capped
    FROM ({stats_sql(name)}) s JOIN ({kinds}) t ON s.col = t.col
    """


def _profile(name: str, order_by):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = profile.profile(table(spark, sf_dir, name), order_by)
        return found.select("name", "dtype", "n_unique", "unique_capped")

    return run


query("p_profile_part", profile_sql("part"))(_profile("part", "p_partkey"))
query("p_profile_lineitem", profile_sql("lineitem"))(_profile("lineitem", "l_orderkey"))
query("p_profile_embeddings", profile_sql("embeddings"))(_profile("embeddings", "vec_id"))


@query(
    "p_samples",
    """
    SELECT name, (row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1)::INT AS position,
           substr(v, 1, 120) AS sample
    FROM (SELECT 'doc_id' AS name, doc_id, doc_id::VARCHAR AS v FROM documents
          UNION ALL SELECT 'text', doc_id, CASE WHEN doc_id % 3 <> 0 THEN text END FROM documents
          UNION ALL SELECT 'lang', doc_id, lang FROM documents
          UNION ALL SELECT 'source', doc_id, source FROM documents
          UNION ALL SELECT 'n_chars', doc_id, n_chars::VARCHAR FROM documents)
    WHERE v IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id) <= 5
    """,
)
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return profile.samples(
        documents.withColumn("text", nulled("doc_id", 3, "text")), "doc_id"
    )


@query("p_guess_text", f'SELECT "table", text_column FROM ({ALL_GUESSES})')
def guess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = side_by_side(
        spark, lambda n: profile.guess_text_column(table(spark, sf_dir, n)), TABLES
    )
    rows = list(zip(TABLES, guesses, strict=True))
    return spark.createDataFrame(rows, "table string, text_column string")


@query(
    "p_guess_text_sample",
    """
    WITH heads AS (
      SELECT 'p_name' AS col, 1 AS i, p_name AS v, p_partkey AS k FROM part
      UNION ALL SELECT 'p_brand', 2, p_brand, p_partkey FROM part
      UNION ALL SELECT 'p_type', 3, CASE WHEN p_partkey % 3 <> 0 THEN p_type END, p_partkey FROM part),
    firsts AS (
      SELECT * FROM heads WHERE v IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY col ORDER BY k) <= 200),
    means AS (SELECT col, i, avg(length(v)) AS len FROM firsts GROUP BY ALL)
    SELECT arg_max(col, (len, -i)) AS text_column FROM means
    """,
)
def guess_text_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_type", nulled("p_partkey", 3, "p_type"))
    guess = profile.guess_text_column(part, order_by="p_partkey")
    return spark.createDataFrame([(guess,)], "text_column string")


@query("p_guess_label", f'SELECT "table", label_column FROM ({ALL_GUESSES})')
def guess_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, profile.label_column(s)) for n, s in all_stats(spark, sf_dir).items()]
    return spark.createDataFrame(rows, "table string, label_column string")


@query(
    "p_preview",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer ORDER BY c_custkey LIMIT 50
    """,
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    head = profile.preview(customer, 50, "c_custkey")
    return head.select(F.from_json("record", customer.schema).alias("r")).select("r.*")


@query(
    "p_suggest",
    f"""
    SELECT doc_id, n_chars, text_column, label_column
    FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 50), ({guess_sql('documents')})
    """,
)
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    record = F.from_json("record", "doc_id bigint, n_chars bigint")
    return profile.suggest(documents, 50, "doc_id").select(
        record.alias("r"), "text_column", "label_column"
    ).select("r.*", "text_column", "label_column")


@query(
    "f_drop_missing",
    """
    SELECT event_id, user_id, event_type, value FROM events
    WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0
    """,
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        nulled("event_id", 7, "event_type").alias("event_type"),
        F.when(F.col("event_id") % 13 == 0, float("nan"))
        .otherwise(nulled("event_id", 11, "value")).alias("value"),
    )
    return filters.drop_missing(events, ["event_type", "value"])


@query(
    "f_nonblank",
    r"""
    SELECT doc_id, length(text) AS n_chars FROM documents
    WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND regexp_matches(text, '[^\s]')
    """,
)
def nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, " \n\t").otherwise(nulled("doc_id", 7, "text"))
    documents = table(spark, sf_dir, "documents").withColumn("text", text)
    kept = filters.nonblank_text(documents, "text", require=True)
    return kept.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "f_resolve",
    f"""
    SELECT "table", kind, given, CASE WHEN given = 'missing' THEN NULL ELSE coalesce(given, guess)
           END AS col, given IS NOT DISTINCT FROM 'missing' OR guess IS NULL AND given IS NULL AS failed
    FROM (SELECT "table", 'text' AS kind, text_column AS guess FROM ({ALL_GUESSES})
          UNION ALL SELECT "table", 'label', label_column FROM ({ALL_GUESSES})),
         (SELECT unnest([NULL, 'missing']) AS given)
    """,
)
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in TABLES:
        df = table(spark, sf_dir, name)
        for kind in ("text", "label"):
            for given in (None, "missing"):
                try:
                    rows.append((name, kind, given, filters.resolve_column(df, given, kind), False))
                except filters.UnknownColumn:
                    rows.append((name, kind, given, None, True))
    return spark.createDataFrame(
        rows, "table string, kind string, given string, col string, failed boolean"
    )


@query(
    "f_check_fit",
    f"""
    WITH guesses AS ({ALL_GUESSES}),
    stats AS ({" UNION ALL ".join(f"SELECT '{n}' AS tab, * FROM ({stats_sql(n)})" for n in TABLES)}),
    known AS (
      SELECT g.*, s.n, s.kind FROM guesses g
      LEFT JOIN stats s ON s.tab = g."table" AND s.col = g.label_column)
    SELECT "table", task,
           CASE WHEN task IN ('text-classification', 'causal-lm') THEN text_column END AS text_column,
           CASE WHEN task <> 'causal-lm' THEN label_column END AS label_column
    FROM known, (SELECT unnest(['text-classification', 'causal-lm', 'tabular-classification',
                                'tabular-regression']) AS task)
    WHERE CASE task
          WHEN 'text-classification' THEN text_column IS NOT NULL AND n BETWEEN 2 AND 100
          WHEN 'causal-lm' THEN text_column IS NOT NULL
          WHEN 'tabular-classification' THEN label_column IS NOT NULL AND n_columns >= 2
          ELSE label_column IS NOT NULL AND n_columns >= 2 AND kind = 'N' END
    """,
)
def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, stats in all_stats(spark, sf_dir).items():
        for task in TASK_NAMES:
            fit = check_fit(task, stats)
            if fit:
                rows.append((name, task, fit.text_column, fit.label_column))
    return spark.createDataFrame(
        rows, "table string, task string, text_column string, label_column string"
    )
