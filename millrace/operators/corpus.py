"""Training texts from instruction pairs, chat turns or plain text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import SLICE_BITS, next_row
from millrace.operators.features import TEST, split
from millrace.operators.filters import drop_missing, nonblank_text, resolve_column
from millrace.operators.profile import quoted

# Usual column pairs in order of preference, and the text made from a pair.
PAIR_NAMES = (
    ("instruction", "output"),
    ("instruction", "response"),
    ("prompt", "response"),
    ("prompt", "completion"),
    ("question", "answer"),
)
BEFORE_PROMPT = "### Instruction:\n"
BEFORE_RESPONSE = "\n\n### Response:\n"

MAX_EVAL_FRACTION = 0.5
MIN_EVAL_ROWS = 20


def pair_columns(df: DataFrame, prompt: str = "", response: str = "") -> tuple[str, str] | None:
    """First named or usual pair of columns the table has; names are case-sensitive."""
    for pair in ((prompt, response), *PAIR_NAMES):
        if all(pair) and set(pair) <= set(df.columns):
            return pair
    return None


def build_texts(df: DataFrame, hp: dict | None = None, order_by=None) -> DataFrame:
    """One training ``text`` per row, next to the other columns of the table."""
    hp = hp or {}
    pair = pair_columns(df, hp.get("prompt_column", ""), hp.get("response_column", ""))
    if pair:
        prompt, response = (quoted(c).cast("string") for c in pair)
        text = F.concat(F.lit(BEFORE_PROMPT), prompt, F.lit(BEFORE_RESPONSE), response)
        return drop_missing(df, pair).withColumn("text", text)
    column = resolve_column(df, hp.get("text_column"), "text", order_by)
    return nonblank_text(df, column, require=True).withColumn("text", quoted(column).cast("string"))


def lm_split(df: DataFrame, fraction: float, seed: int, key: str | Column) -> DataFrame:
    """Held-out flag for a text corpus; none are held out below 20 rows.

    The fraction is limited to 0..0.5, and ``ceil(fraction * rows)`` rows are held out.
    """
    fraction = min(max(fraction, 0.0), MAX_EVAL_FRACTION)
    if fraction <= 0 or df.limit(MIN_EVAL_ROWS).count() < MIN_EVAL_ROWS:
        return df.withColumn(TEST, F.lit(False))
    return split(df, fraction, seed, key, exact=True)


def turns_to_pairs(turns: DataFrame, bits: int = SLICE_BITS) -> DataFrame:
    """``(conv_id, turn, prompt, response)`` for each user turn an assistant turn follows."""
    following = next_row(turns, ["conv_id"], "turn", ["role", "text"], "next", bits)
    return following.where("role = 'user' AND next.role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col("next.text").alias("response")
    )
