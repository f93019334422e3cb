from __future__ import annotations

import random
import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import hash32
from millrace.operators import corpus, features, train
from millrace.session import workspace


def test_medians_in_many_rounds(spark):
    rnd = random.Random(5)
    rows = [
        (
            rnd.gauss(0, 1),
            7.0 if rnd.random() < 0.4 else rnd.random() * 14,  # a hot value at the middle
            rnd.choice([1.0, 2.0]),
            rnd.choice([None, float("nan"), rnd.randint(0, 10_000) * 1.0]),
            None,
        )
        for _ in range(4_000)
    ]
    names = ["normal", "hot", "two", "holes", "empty"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = features.medians(df, names, limit=20)
    for i, name in enumerate(names[:4]):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[name] == statistics.median(values), name
    assert "empty" not in got


@pytest.mark.parametrize("n", [1, 2, 3, 50, 51])
def test_medians_of_few(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).alias("x"))
    assert features.medians(df, ["x"], limit=1)["x"] == statistics.median(i * i for i in range(n))


def test_scaled_values_after_imputation(spark):
    values = [1.0, None, 4.0, 10.0, None]
    df = spark.createDataFrame([(v, 3) for v in values], "x double, same int")
    fitted = features.fit_numeric(df, ["x", "same"])
    filled = [v if v is not None else 4.0 for v in values]
    mean, dev = statistics.mean(filled), statistics.pstdev(filled)
    got = [r.x for r in features.scale(df, fitted).collect()]
    assert got == pytest.approx([(v - mean) / dev for v in filled])
    assert [f.deviation for f in fitted] == [pytest.approx(dev), 1.0]


def test_categories(spark):
    rows = [("b",), ("b",), ("a",), ("a",), ("once",), ("",), ("",), (None,), ("it's",)]
    df = spark.createDataFrame(rows, "c string")
    (f,) = features.fit_categorical(df, ["c"])
    assert (f.mode, f.frequent, f.infrequent) == ("", ["", "a", "b"], ["it's", "once"])
    score = spark.createDataFrame([*rows, ("new",)], "c string")
    got = [r.slot for r in score.select(f.slot().alias("slot")).collect()]
    assert got == [2, 2, 1, 1, 3, 0, 0, 0, 3, None]


def test_exact_split_sizes(spark):
    rows = [(i, "x" if i % 3 else "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    plain = features.split(df, 0.25, 1, "k", exact=True)
    assert plain.where("is_test").count() == 250
    strata = features.split(df, 0.25, 1, "k", "s", exact=True)
    counts = {r.s: r.n for r in strata.where("is_test").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert counts == {"x": 167, "y": 83}  # both halves are equal, "x" comes first
    # The smallest hashes are held out.
    hashed = plain.select("is_test", hash32(1, F.col("k")).alias("h"))
    assert hashed.where("is_test").agg(F.max("h")).head()[0] < hashed.where("NOT is_test").agg(F.min("h")).head()[0]


def test_exact_split_of_equal_rows(spark):
    """A third of the rows share one key, which falls on one side as a whole."""
    df = spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("k"))
    for fraction in (0.1, 0.4, 0.7):
        parts = features.split(df, fraction, 3, "k", exact=True)
        sizes = {r.k: r.n for r in parts.where("is_test").groupBy("k").agg(F.count("*").alias("n")).collect()}
        assert sizes.get(-1, 0) in (0, 300)
        assert 900 * fraction <= sum(sizes.values()) <= 900 * fraction + 300


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5_000)
    one = features.split(df.coalesce(1), 0.2, 42, "id").where("is_test")
    many = features.split(df.repartition(8), 0.2, 42, "id").where("is_test")
    assert {r.id for r in one.collect()} == {r.id for r in many.collect()}
    other = features.split(df, 0.2, 43, "id").where("is_test")
    assert one.join(other, "id").count() < 400


def test_stratified_sizes():
    assert features.held_out_sizes({"a": 5, "b": 5, "c": 1}, 0.2) == {"a": 2, "b": 1, "c": 0}
    assert sum(features.held_out_sizes({"a": 7, "b": 8}, 0.5).values()) == 8


@pytest.mark.parametrize("rows, held_out", [(19, False), (20, True)])
def test_corpus_split_needs_twenty_rows(spark, rows, held_out):
    parts = corpus.lm_split(spark.range(rows), 0.5, 42, "id")
    assert (parts.where("is_test").count() > 0) == held_out
    assert corpus.lm_split(spark.range(rows), 0.0, 42, "id").where("is_test").count() == 0


def test_small_corpus_holds_out_one_row(spark):
    assert corpus.lm_split(spark.range(20), 0.05, 42, "id").where("is_test").count() == 1


def birds(spark):
    """150 rows like the usual sample of three species."""
    rnd = random.Random(9)
    kinds = {"Adelie": (39, 18, 190, 3700), "Chinstrap": (49, 18, 196, 3700), "Gentoo": (47, 15, 217, 5000)}
    rows = []
    for i in range(150):
        kind = list(kinds)[i % 3]
        bill, depth, flipper, mass = kinds[kind]
        rows.append(
            (
                kind, rnd.choice(["Dream", "Biscoe"]), rnd.gauss(bill, 1.5), rnd.gauss(depth, 0.6),
                int(rnd.gauss(flipper, 4)), None if i % 17 == 0 else int(rnd.gauss(mass, 200)),
                rnd.choice(["male", "female"]), i,
            )
        )
    return spark.createDataFrame(
        rows,
        "species string, island string, bill_length_mm double, bill_depth_mm double, "
        "flipper_length_mm int, body_mass_g int, sex string, id int",
    )


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting", "logistic_regression"])
def test_classifiers_learn(spark, algorithm):
    hp = {"label_column": "species", "algorithm": algorithm, "n_estimators": 8}
    trained = train.train_tabular(birds(spark).drop("id"), "tabular-classification", hp)
    assert trained.metrics["accuracy"] >= 0.9
    assert (trained.metrics["train_rows"], trained.metrics["test_rows"]) == (120, 30)


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting", "linear_regression"])
def test_regressors_learn(spark, algorithm):
    hp = {"label_column": "bill_depth_mm", "algorithm": algorithm, "n_estimators": 20}
    trained = train.train_tabular(birds(spark), "tabular-regression", hp, "id")
    assert trained.metrics["r2"] > 0.4
    assert trained.metrics["mae"] <= trained.metrics["rmse"]


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError, match="random_forest"):
        train.train_tabular(birds(spark), "tabular-classification", {"algorithm": "magic"})


def test_saved_model_scores_new_rows(spark):
    df = birds(spark)
    hp = {"label_column": "species", "n_estimators": 5}
    trained = train.train_tabular(df, "tabular-classification", hp, "id")
    path = workspace(spark, "birds")
    train.save_model(trained, spark, path)
    new = df.drop("species").withColumn("island", F.lit("Unheard of"))
    scored = train.score(path, new)
    assert scored.count() == 150
    assert {r.predicted for r in scored.select("predicted").distinct().collect()} <= {"Adelie", "Chinstrap", "Gentoo"}


def test_pairs_need_exact_names(spark):
    df = spark.createDataFrame([("p", "r", "t")], "Prompt string, response string, text string")
    assert corpus.pair_columns(df) is None
    assert corpus.build_texts(df).head().text == "t"
    named = corpus.build_texts(df, {"prompt_column": "Prompt", "response_column": "response"})
    assert named.head().text == "### Instruction:\np\n\n### Response:\nr"
    blank = spark.createDataFrame([("  \n",)], "text string")
    with pytest.raises(ValueError, match="no usable text"):
        corpus.build_texts(blank)


def test_medians_of_many_columns_share_the_limit(spark):
    n, names = 500, [f"c{i}" for i in range(50)]
    df = spark.range(n).select(*[((F.col("id") * (2 * i + 1)) % 997).cast("double").alias(c) for i, c in enumerate(names)])
    got = features.medians(df, names, limit=1000)
    for i, c in enumerate(names):
        assert got[c] == statistics.median(k * (2 * i + 1) % 997 for k in range(n))


def test_too_many_categories_are_refused(spark):
    df = spark.range(1000).select(
        F.lit("x").alias("few"), F.concat(F.lit("v"), (F.col("id") % 201).cast("string")).alias("many")
    )
    with pytest.raises(ValueError, match="'many' has more than 200"):
        features.fit_categorical(df, ["few", "many"])
    most = df.withColumn("many", F.when(F.col("many") != "v7", F.col("many")))
    few, many = features.fit_categorical(most, ["few", "many"])
    assert few.mode == "x" and len(many.frequent) == 200


def test_partitions_follow_the_size_of_the_vectors(spark):
    wide = SimpleNamespace(numeric=[1], categorical=[SimpleNamespace(labels=lambda: ["x"] * 200)] * 5)
    rows = spark.range(10).coalesce(1)
    assert train.spread(rows, 1_000_000, wide).rdd.getNumPartitions() == 61
    assert train.spread(rows, 1000, wide).rdd.getNumPartitions() == 1
