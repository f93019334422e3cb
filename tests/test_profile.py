from __future__ import annotations

import pytest
from conftest import MIDDLE
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.operators.filters import check_fit, resolve_column
from millrace.plans.common import TABLES, table

GUESSES = {  # text and label column of the given tables
    "region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_regionkey"),
    "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name", "s_nationkey"),
    "part": ("p_name", "p_type"), "orders": ("o_orderpriority", "o_orderstatus"),
    "lineitem": ("l_returnflag", "l_linestatus"), "events": ("props", "event_type"),
    "documents": ("text", "lang"), "embeddings": (None, "label"), "pages": ("html", None),
    "benchmark": ("text", "item_id"), "labels": (None, "quality"),
    "conversations": ("text", "role"),
}


@pytest.mark.parametrize("name", TABLES)
def test_guesses(spark, name):
    stats = profile.column_stats(table(spark, MIDDLE, name))
    assert (profile.text_column(stats), profile.label_column(stats)) == GUESSES[name]


@pytest.mark.parametrize("rows", [5_000, 30_000])
@pytest.mark.parametrize("distinct", [1, 2, 999, 1000, 1001, 4_500])
def test_capped_counts(spark, rows, distinct):
    ids = spark.range(rows, numPartitions=4)
    df = ids.select(
        (F.col("id") % distinct).alias("spread"),
        # Values in a row: the first rows show few of them.
        F.least(F.floor(F.col("id") / 2), F.lit(distinct - 1)).cast("double").alias("clustered"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), (F.col("id") % distinct).cast("string")))
        .alias("holes"),
    )
    stats = profile.column_stats(df)
    assert stats.rows == rows
    for c in stats.columns:
        exact = df.agg(F.count_distinct(c.name)).head()[0]
        assert c.n_unique == min(exact, 1000), c.name


def test_clustered_column_with_many_values(spark):
    df = spark.range(40_000, numPartitions=4).select(
        F.when(F.col("id") < 15_000, 0).otherwise(F.col("id")).alias("late")
    )
    assert profile.column_stats(df).column("late").n_unique == 1000


def test_missing_and_signed_zero(spark):
    rows = [(0.0, None), (-0.0, None), (float("nan"), None), (None, None), (1.5, None)]
    stats = profile.column_stats(spark.createDataFrame(rows, "x double, nothing string"))
    assert stats.column("x").n_unique == 2
    assert stats.column("nothing").n_unique == 0
    assert stats.column("nothing").mean_length is None


def test_profile_row(spark):
    df = spark.createDataFrame(
        [(i, "y" * 200 if i else None, [i]) for i in range(7)], "k bigint, t string, a array<int>"
    )
    rows = {r.name: r for r in profile.profile(df, "k").collect()}
    assert rows["k"].samples == ["0", "1", "2", "3", "4"]
    assert rows["t"].samples == ["y" * 120] * 5
    assert (rows["a"].n_unique, rows["a"].unique_capped) == (None, False)
    assert rows["t"].n_unique == 1


def test_samples_look_past_missing_values(spark):
    df = spark.range(200).select("id", F.when(F.col("id") > 100, F.col("id")).alias("late"))
    assert profile.sample_values(df, "id") == {
        "id": ["0", "1", "2", "3", "4"], "late": ["101", "102", "103", "104", "105"],
    }


def test_usual_names_win(spark):
    df = spark.createDataFrame([("a", "b", 1, 2)], "Review string, TEXT string, Y int, Target int")
    assert profile.guess_text_column(df) == "TEXT"
    assert profile.guess_label_column(df) == "Target"


def test_text_guess_of_first_rows(spark):
    rows = [(i, "long text" if i < 200 else "x", "short" if i < 200 else "z" * 99) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    assert profile.guess_text_column(df) == "b"
    assert profile.guess_text_column(df, order_by="k") == "a"


@pytest.mark.parametrize("classes, fits", [(1, False), (2, True), (100, True), (101, False)])
def test_fit_limits(spark, classes, fits):
    df = spark.range(500).select(
        F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"),
        (F.col("id") % classes).alias("label"),
    )
    stats = profile.column_stats(df)
    assert (check_fit("text-classification", stats) is not None) == fits
    assert check_fit("tabular-regression", stats).label_column == "label"


def test_resolve(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    with pytest.raises(ValueError, match="available"):
        resolve_column(df, None, "text")
    with pytest.raises(ValueError, match="available"):
        resolve_column(df, "other", "label")
    assert resolve_column(df, "n", "text") == "n"


def test_rows_without_an_order_key_come_last(spark):
    from millrace.operators.profile import sample_values

    frame = spark.createDataFrame([("a", None), ("b", None), ("c", 1)], "v string, k int")
    found = sample_values(frame, "k")["v"]
    assert found[0] == "c" and sorted(found) == ["a", "b", "c"]
