"""Quality measures of predictions, each one aggregate over the scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.profile import quoted

PLACES = 4
SMALLEST_PROBABILITY = 1e-15


def accuracy_of(truth: str, predicted: str) -> Column:
    hit = quoted(truth).eqNullSafe(quoted(predicted)).cast("double")
    return F.round(F.avg(hit), PLACES).alias("accuracy")


def log_loss_of(probability: str) -> Column:
    p = F.greatest(quoted(probability), F.lit(SMALLEST_PROBABILITY))
    return F.round(F.avg(-F.ln(p)), PLACES).alias("eval_loss")


def accuracy(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    return scored.agg(accuracy_of(truth, predicted))


def log_loss(scored: DataFrame, probability: str) -> DataFrame:
    """Mean cross-entropy, given each row's probability of its true class."""
    return scored.agg(log_loss_of(probability))


def _per_label(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Hits, misses and true rows of every label that is true or predicted somewhere."""
    pairs = scored.groupBy(
        quoted(truth).cast("string").alias("t"), quoted(predicted).cast("string").alias("p")
    ).agg(F.count("*").alias("n"))
    hit = F.col("t").eqNullSafe(F.col("p"))
    zero = F.lit(0).cast("bigint")
    hits = F.when(hit, F.col("n")).otherwise(zero).alias("hits")
    misses = F.when(hit, zero).otherwise(F.col("n")).alias("misses")
    sides = F.array(
        F.struct(F.col("t").alias("label"), hits, misses, F.col("n").alias("rows")),
        F.struct(F.col("p").alias("label"), zero.alias("hits"), misses, zero.alias("rows")),
    )
    sums = [F.sum(c).alias(c) for c in ("hits", "misses", "rows")]
    return pairs.select(F.inline(sides)).groupBy("label").agg(*sums)


def _f1_of() -> Column:
    f1 = 2.0 * F.col("hits") / (2 * F.col("hits") + F.col("misses"))
    return F.round(F.avg(F.when(F.col("hits") > 0, f1).otherwise(0.0)), PLACES).alias("f1_macro")


def f1_macro(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean F1 over all labels that are true or predicted somewhere; undefined counts 0."""
    return _per_label(scored, truth, predicted).agg(_f1_of())


def regression_metrics(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean squared error and R² in one pass."""
    y, p = quoted(truth).cast("double"), quoted(predicted).cast("double")
    squared = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    r2 = F.when(spread > 0, 1 - squared / spread).when(squared == 0, 1.0).otherwise(0.0)
    return scored.agg(
        F.round(F.avg(F.abs(y - p)), PLACES).alias("mae"),
        F.round(F.sqrt(squared), PLACES).alias("rmse"),
        F.round(r2, PLACES).alias("r2"),
    )


def row_counts(split: DataFrame, test_flag: str, label: str | None = None) -> DataFrame:
    """Training and held-out rows, and the number of classes if a label is named."""
    flag = F.col(test_flag)
    out = [F.count_if(~flag).alias("train_rows"), F.count_if(flag).alias("test_rows")]
    if label:
        out.append(F.count_distinct(quoted(label)).alias("num_classes"))
    return split.agg(*out)


def evaluate(scored: DataFrame, kind: str, truth: str, predicted: str) -> DataFrame:
    """All measures of a ``classification`` or ``regression`` as one row."""
    if kind == "regression":
        return regression_metrics(scored, truth, predicted)
    share = F.round(F.sum("hits") / F.sum("rows"), PLACES).alias("accuracy")
    return _per_label(scored, truth, predicted).agg(share, _f1_of())
