"""Queries on features, splits, estimators, scores and training texts."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import HASH_RANGE, words
from millrace.operators import corpus, evaluate, features, tasks, train
from millrace.plans.common import nulled, query, table
from millrace.plans.profiling import stats_sql
from millrace.session import workspace

SEED = 42


def bucket_sql(key: str, seed: int = SEED) -> str:
    """The seeded hash of :func:`hash32` in SQL."""
    return f"concat('0x', substr(md5(concat({seed}, '|', {key})), 1, 8))::BIGINT"


def held_out_sql(key: str, fraction: float, seed: int = SEED) -> str:
    return f"({bucket_sql(key, seed)} < {int(fraction * HASH_RANGE)})"


# ---------------------------------------------------------------- preparation

ROLE_LABELS = {"part": "p_type", "customer": "c_mktsegment", "lineitem": "l_linestatus"}


def _roles_sql(name: str, label: str) -> str:
    return f"""
    SELECT '{name}' AS "table", col,
           CASE WHEN kind = 'N' THEN 'numeric' WHEN n <= 200 THEN 'categorical'
                ELSE 'dropped' END AS role
    FROM ({stats_sql(name)}) WHERE col <> '{label}'
    """


@query("t_feature_roles", " UNION ALL ".join(_roles_sql(n, c) for n, c in ROLE_LABELS.items()))
def feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, label in ROLE_LABELS.items():
        roles = features.feature_roles(table(spark, sf_dir, name), label)
        for role in ("numeric", "categorical", "dropped"):
            rows += [(name, column, role) for column in getattr(roles, role)]
    return spark.createDataFrame(rows, "table string, col string, role string")


@query(
    "t_impute_median",
    """
    WITH holes AS (
      SELECT l_orderkey, l_linenumber, l_partkey,
             CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice,
             CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity FROM lineitem),
    middle AS (SELECT median(l_extendedprice) AS p, median(l_quantity) AS q FROM holes)
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(coalesce(l_extendedprice, p), 4) AS l_extendedprice,
           round(coalesce(l_quantity, q), 4) AS l_quantity
    FROM holes, middle
    """,
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        nulled("l_orderkey", 7, "l_extendedprice").alias("l_extendedprice"),
        nulled("l_orderkey", 5, "l_quantity").alias("l_quantity"),
    )
    fitted = features.fit_numeric(lines, ["l_extendedprice", "l_quantity"])
    done = features.impute_median(lines, fitted)
    return done.withColumns(
        {c: F.round(c, 4) for c in ("l_extendedprice", "l_quantity")}
    )


@query(
    "t_scale",
    """
    SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 5) + 0 AS p_size,
           round((p_retailprice - avg(p_retailprice) OVER ())
                 / stddev_pop(p_retailprice) OVER (), 5) + 0 AS p_retailprice,
           0.0::DOUBLE AS same
    FROM part
    """,
)
def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.lit(7).alias("same")
    )
    names = ["p_size", "p_retailprice", "same"]
    done = features.scale(part, features.fit_numeric(part, names))
    return done.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in names})


@query(
    "t_impute_mode",
    """
    WITH holes AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders),
    a AS (SELECT o_orderstatus AS v FROM holes WHERE o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    b AS (SELECT o_orderpriority AS v FROM holes WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(o_orderstatus, a.v) AS o_orderstatus,
           coalesce(o_orderpriority, b.v) AS o_orderpriority
    FROM holes, a, b
    """,
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        nulled("o_orderkey", 3, "o_orderstatus").alias("o_orderstatus"),
        nulled("o_orderkey", 7, "o_orderpriority").alias("o_orderpriority"),
    )
    fitted = features.fit_categorical(orders, ["o_orderstatus", "o_orderpriority"])
    return features.impute_mode(orders, fitted)


# Training rows are those outside the split; one of them gets a category of its own and
# held-out customers of nation 3 one that training never saw.
ONEHOT_ROWS = f"""
    SELECT c_custkey, {held_out_sql('c_custkey', 0.2)} AS is_test,
           CASE WHEN c_custkey = first_key THEN 'RARE'
                WHEN c_nationkey = 3 AND {held_out_sql('c_custkey', 0.2)} THEN 'UNSEEN'
                ELSE c_mktsegment END AS segment
    FROM customer,
         (SELECT min(c_custkey) AS first_key FROM customer
          WHERE NOT {held_out_sql('c_custkey', 0.2)})
"""


def onehot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.split(table(spark, sf_dir, "customer"), 0.2, SEED, "c_custkey")
    first = rows.where(~F.col("is_test")).agg(F.min("c_custkey")).head()[0]
    segment = (
        F.when(F.col("c_custkey") == first, "RARE")
        .when((F.col("c_nationkey") == 3) & F.col("is_test"), "UNSEEN")
        .otherwise(F.col("c_mktsegment"))
    )
    return rows.select("c_custkey", "is_test", segment.alias("segment"))


@query(
    "t_onehot",
    f"""
    WITH placed AS ({ONEHOT_ROWS}),
    counts AS (SELECT segment, count(*) AS n FROM placed WHERE NOT is_test GROUP BY 1),
    slots AS (
      SELECT segment, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY n >= 2 ORDER BY segment) - 1
                           ELSE (SELECT count(*) FROM counts WHERE n >= 2) END AS slot
      FROM counts)
    SELECT c_custkey, is_test, p.segment, slot
    FROM placed p LEFT JOIN slots s ON p.segment = s.segment
    """,
)
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = onehot_rows(spark, sf_dir)
    (fitted,) = features.fit_categorical(rows.where(~F.col("is_test")), ["segment"])
    return rows.withColumn("slot", fitted.slot().cast("bigint"))


@query(
    "t_assemble",
    """
    WITH seen AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer),
    slots AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) AS slot
              FROM (SELECT DISTINCT c_mktsegment FROM customer)),
    width AS (SELECT max(slot) AS k FROM slots)
    SELECT c_custkey, pos, CASE WHEN pos = 0 THEN round((c_acctbal - m) / s, 5) + 0
                                WHEN pos = slot THEN 1.0 ELSE 0.0 END::DOUBLE AS x
    FROM customer JOIN slots ON v = c_mktsegment, seen,
         (SELECT unnest(range(k + 1)) AS pos FROM width)
    """,
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    roles = features.Roles(["c_acctbal"], ["c_mktsegment"], [])
    stages = train.preparation_stages(features.fit_preparation(customer, roles))
    vectors = Pipeline(stages=stages).fit(customer).transform(customer)
    array = vector_to_array(train.VECTOR)
    return vectors.select("c_custkey", F.posexplode(array).alias("pos", "x")).select(
        "c_custkey", F.col("pos").cast("bigint").alias("pos"),
        (F.round("x", 5) + F.lit(0.0)).alias("x"),
    )


@query("t_split", f"SELECT o_orderkey, {held_out_sql('o_orderkey', 0.2)} AS is_test FROM orders")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return features.split(orders, 0.2, SEED, "o_orderkey")


@query(
    "t_split_stratified",
    f"""
    WITH sizes AS (
      SELECT c_mktsegment, n, n * t // r AS low, n * t % r AS part, t
      FROM (SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1),
           (SELECT count(*)::BIGINT AS r, ceil(count(*) * 0.2)::BIGINT AS t FROM customer)),
    wanted AS (
      SELECT c_mktsegment, low + (row_number() OVER (ORDER BY part DESC, c_mktsegment)
                                  <= t - sum(low) OVER ())::INT AS take FROM sizes)
    SELECT c_custkey, c_mktsegment,
           row_number() OVER (PARTITION BY c_mktsegment
                              ORDER BY {bucket_sql('c_custkey')}, c_custkey::VARCHAR)
           <= take AS is_test
    FROM customer JOIN wanted USING (c_mktsegment)
    """,
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return features.split(customer, 0.2, SEED, "c_custkey", "c_mktsegment", exact=True)


# ---------------------------------------------------------------- estimators


def _metrics(spark: SparkSession, trained: train.Trained) -> DataFrame:
    rows = [(k, float(v)) for k, v in sorted(trained.metrics.items())]
    return spark.createDataFrame(rows, "metric string, value double")


def _train(name: str, source: str, task: str, label: str, key: str, **hp):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return _metrics(spark, train.train_tabular(rows, task, {"label_column": label, **hp}, key))

    query(name)(run)


CLASSIFY, REGRESS = "tabular-classification", "tabular-regression"


@query(
    "e_train_sizes",
    """
    SELECT ceil(n * 0.2)::BIGINT AS test_rows, n - ceil(n * 0.2)::BIGINT AS train_rows, kept
    FROM (SELECT count(*) FILTER (c_custkey % 9 <> 0) AS n,
                 (SELECT count(DISTINCT c_mktsegment) FROM customer) AS kept FROM customer)
    """,
)
def train_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a whole training run uses, of a table with missing labels."""
    customer = table(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", nulled("c_custkey", 9, "c_mktsegment")
    )
    settings = {"label_column": "c_mktsegment", "algorithm": "logistic_regression"}
    trained = train.train_tabular(customer, CLASSIFY, settings, "c_custkey")
    labels = len(trained.model.stages[-1].getLabels())
    rows = [(trained.metrics["train_rows"], trained.metrics["test_rows"], labels)]
    return spark.createDataFrame(rows, "train_rows bigint, test_rows bigint, kept bigint")


_train("e_rf_cls", "customer", CLASSIFY, "c_mktsegment", "c_custkey",
       algorithm="random_forest", n_estimators=10, max_depth=5)
_train("e_rf_reg", "part", REGRESS, "p_retailprice", "p_partkey", algorithm="random_forest")
_train("e_gbt_cls", "orders", CLASSIFY, "o_orderstatus", "o_orderkey",
       algorithm="gradient_boosting", n_estimators=3, max_depth=3)
_train("e_gbt_reg", "part", REGRESS, "p_retailprice", "p_partkey",
       algorithm="gradient_boosting", n_estimators=10, max_depth=3)
_train("e_logreg", "customer", CLASSIFY, "c_mktsegment", "c_custkey",
       algorithm="logistic_regression")


@query(
    "e_linreg",
    f"""
    WITH held AS (SELECT *, {held_out_sql('p_partkey', 0.2)} AS is_test FROM part),
    line AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a
             FROM held WHERE NOT is_test)
    SELECT p_partkey, round(a + b * p_size, 3) AS predicted FROM held, line WHERE is_test
    """,
)
def linreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    parts = features.split(part, 0.2, SEED, "p_partkey")
    fit_on = parts.where(~F.col("is_test"))
    fitted = features.fit_preparation(fit_on, features.Roles(["p_size"], [], []))
    estimator = train.make_estimator(REGRESS, {"algorithm": "linear_regression"})
    stages = [*train.preparation_stages(fitted), estimator]
    model = Pipeline(stages=stages).fit(fit_on.withColumn(train.INDEX, F.col("p_retailprice")))
    return model.transform(parts.where("is_test")).select(
        "p_partkey", F.round(train.PREDICTION, 3).alias("predicted")
    )


# ---------------------------------------------------------------- evaluation

# Orders read as scored rows: the status is true, the priority's first digit decides the guess.
SCORED = """
    SELECT o_orderkey, o_orderstatus AS truth,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus
                WHEN o_orderpriority LIKE '1%' THEN 'F' WHEN o_orderpriority LIKE '2%' THEN 'O'
                ELSE 'X' END AS predicted,
           o_totalprice AS y, o_totalprice + (o_orderkey % 101 - 50) * 100.0 AS p,
           (o_orderkey % 100) / 100.0 AS probability
    FROM orders
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    guess = (
        F.when(key % 3 == 0, F.col("o_orderstatus"))
        .when(F.col("o_orderpriority").startswith("1"), "F")
        .when(F.col("o_orderpriority").startswith("2"), "O")
        .otherwise("X")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("truth"),
        guess.alias("predicted"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") + (key % 101 - 50) * 100.0).alias("p"),
        ((key % 100) / 100.0).alias("probability"),
    )


@query("e_accuracy", f"SELECT round(avg((truth = predicted)::INT), 4) AS accuracy FROM ({SCORED})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(scored(spark, sf_dir), "truth", "predicted")


@query(
    "e_f1_macro",
    f"""
    WITH s AS ({SCORED}),
    labels AS (SELECT truth AS label FROM s UNION SELECT predicted FROM s),
    f AS (SELECT label, count(*) FILTER (truth = label AND predicted = label) AS tp,
                 count(*) FILTER (truth <> label AND predicted = label) AS fp,
                 count(*) FILTER (truth = label AND predicted <> label) AS fn
          FROM labels JOIN s ON label = truth OR label = predicted GROUP BY 1)
    SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 4) AS f1_macro FROM f
    """,
)
def f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.f1_macro(scored(spark, sf_dir), "truth", "predicted")


@query(
    "e_regression_metrics",
    f"""
    SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
           round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2
    FROM ({SCORED})
    """,
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.regression_metrics(scored(spark, sf_dir), "y", "p")


@query(
    "e_row_counts",
    f"""
    SELECT count(*) FILTER (NOT t) AS train_rows, count(*) FILTER (t) AS test_rows,
           count(DISTINCT o_orderstatus) AS num_classes
    FROM (SELECT o_orderstatus, {held_out_sql('o_orderkey', 0.2)} AS t FROM orders)
    """,
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = features.split(table(spark, sf_dir, "orders"), 0.2, SEED, "o_orderkey")
    return evaluate.row_counts(parts, features.TEST, "o_orderstatus")


@query(
    "e_log_loss",
    f"SELECT round(avg(-ln(greatest(probability::DOUBLE, 1e-15))), 4) AS eval_loss FROM ({SCORED})",
)
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.log_loss(scored(spark, sf_dir), "probability")


def _saved(spark: SparkSession, sf_dir: str) -> str:
    customer = table(spark, sf_dir, "customer")
    trained = train.train_tabular(
        customer, CLASSIFY,
        {"label_column": "c_mktsegment", "algorithm": "random_forest", "n_estimators": 5,
         "max_depth": 4},
        "c_custkey",
    )
    path = workspace(spark, "model")
    train.save_model(trained, spark, path)
    return path


@query(
    "e_save_load",
    f"""
    SELECT 'c_mktsegment' AS label_column, col AS feature, 'tabular-classification' AS task
    FROM ({_roles_sql("customer", "c_mktsegment")}) WHERE role <> 'dropped'
    """,
)
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.read.json(f"{_saved(spark, sf_dir)}/columns")
    return meta.select("label_column", F.explode("feature_columns").alias("feature"), "task")


@query("e_score", "SELECT c_custkey, true AS known FROM customer")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    named = train.score(_saved(spark, sf_dir), customer.drop("c_mktsegment"))
    segments = customer.select(F.col("c_mktsegment").alias("predicted")).distinct()
    return named.join(segments, "predicted", "left").select(
        "c_custkey", F.col("predicted").isNotNull().alias("known")
    )


# ---------------------------------------------------------------- texts


@query(
    "x_encode_labels",
    """
    SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS label_id
    FROM (SELECT DISTINCT lang FROM documents)
    """,
)
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.encode_labels(table(spark, sf_dir, "documents"), "lang")


@query(
    "x_tokenize",
    r"""
    SELECT doc_id, len(w) AS n_words, w[1] AS first_word, w[-1] AS last_word
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'),
                                     lambda t: t <> '')[1:256] AS w FROM documents)
    """,
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text"), 256).alias("w"))
    return found.select(
        "doc_id", F.size("w").cast("bigint").alias("n_words"),
        F.get("w", F.lit(0)).alias("first_word"), F.get("w", F.size("w") - 1).alias("last_word"),
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label")
    )


@query("x_train_text")
def train_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the best of three epochs, the default."""
    return _metrics(spark, train.train_text(labelled_texts(spark, sf_dir), {}, "doc_id"))


@query(
    "x_train_points",
    """
    WITH used AS (
      SELECT quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
    sizes AS (SELECT count(*) AS n, count(DISTINCT quality) AS classes FROM used)
    SELECT e::INT AS epoch, (e * 10)::INT AS step, ceil(n * 0.1)::BIGINT AS eval_rows,
           n - ceil(n * 0.1)::BIGINT AS train_rows, classes AS num_classes, true AS below_chance_loss, true AS is_share
    FROM sizes, range(1, 4) r(e)
    """,
)
def train_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per epoch, and whether its loss is below that of guessing."""
    trained = train.train_text(labelled_texts(spark, sf_dir), {}, "doc_id")
    found = trained.metrics
    rows = [
        (p["epoch"], p["step"], found["eval_rows"], found["train_rows"], found["num_classes"],
         p["loss"] < math.log(found["num_classes"]), 0.0 <= p["accuracy"] <= 1.0)
        for p in trained.history
    ]
    return spark.createDataFrame(
        rows,
        "epoch int, step int, eval_rows bigint, train_rows bigint, num_classes bigint, below_chance_loss boolean, is_share boolean",
    )


PAIRS = """
    SELECT conv_id, turn, text AS prompt, next_text AS response
    FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'
"""


@query("x_turns", PAIRS)
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))


@query(
    "x_pairs",
    f"""
    SELECT conv_id, turn, '### Instruction:' || chr(10) || prompt || chr(10) || chr(10)
           || '### Response:' || chr(10) || response AS text
    FROM ({PAIRS}) WHERE turn % 5 <> 0
    """,
)
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))
    holes = found.withColumn("response", nulled("turn", 5, "response"))
    return corpus.build_texts(holes).select("conv_id", "turn", "text")


@query(
    "x_plain_texts",
    "SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0 AND regexp_matches(text, '[^\\s]')",
)
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("text"))
    documents = table(spark, sf_dir, "documents").withColumn("text", text)
    return corpus.build_texts(documents).select("doc_id", "text")


@query("x_split", f"SELECT doc_id, {held_out_sql('doc_id', 0.1)} AS is_test FROM documents")
def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return features.split(documents, 0.1, SEED, "doc_id")


@query(
    "x_lm_split",
    f"""
    SELECT 'documents' AS src, doc_id AS id,
           row_number() OVER (ORDER BY {bucket_sql('doc_id', SEED)}, doc_id::VARCHAR)
             <= ceil(count(*) OVER () * 0.5) AS is_test
    FROM documents
    UNION ALL
    SELECT 'nations', n_nationkey,
           row_number() OVER (ORDER BY {bucket_sql('n_nationkey::BIGINT', SEED)}, n_nationkey::VARCHAR)
             <= ceil(count(*) OVER () * 0.05)
    FROM nation
    UNION ALL SELECT 'none', doc_id, false FROM documents
    UNION ALL SELECT 'regions', r_regionkey, false FROM region
    """,
)
def lm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    nations = table(spark, sf_dir, "nation")
    nations = nations.select(F.col("n_nationkey").cast("bigint").alias("id"))
    cases = (
        ("documents", documents, 0.9), ("nations", nations, 0.05),
        ("none", documents, -1.0), ("regions", regions, 0.3),
    )
    out = None
    for name, rows, fraction in cases:
        part = corpus.lm_split(rows, fraction, SEED, "id").select(F.lit(name).alias("src"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- a task of one's own


@query(
    "u_custom_task",
    """
    SELECT o_orderstatus AS class, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1
    """,
)
def custom_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    def class_means(df: DataFrame, hp: dict, say) -> dict:
        means = df.groupBy(hp["label_column"]).agg(F.round(F.avg(hp["value"]), 2).alias("m"))
        return {r[0]: r.m for r in means.collect()}

    name = "class-means"
    if name not in tasks.TASKS:
        tasks.register_task(
            tasks.Task(
                name,
                (tasks.Param("label_column", "str", ""), tasks.Param("value", "str", "")),
                class_means,
            )
        )
    user = {"label_column": "o_orderstatus", "value": "o_totalprice"}
    outcome = tasks.run_task(name, table(spark, sf_dir, "orders"), user)
    if outcome.error:
        raise RuntimeError(outcome.error)
    return spark.createDataFrame(list(outcome.metrics.items()), "class string, mean double")
