"""Column expressions that read a goal written in plain language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import once

# Task names, and the phrases that select them, tried in this order.
TASK_NAMES = (
    "text-classification",
    "causal-lm",
    "tabular-classification",
    "tabular-regression",
)
TASK_PHRASES = (
    (
        "causal-lm",
        (
            "fine-tune", "finetune", "chatbot", "chat bot", "generate text", "language model",
            "llm", "instruction", "assistant", "write like",
        ),
    ),
    (
        "tabular-regression",
        (
            "price", "value", "amount", "number", "regression", "estimate", "forecast",
            "how much", "how many",
        ),
    ),
    (
        "text-classification",
        (
            "sentiment", "classify text", "text class", "review", "toxic", "spam", "intent",
            "emotion", "topic", "news",
        ),
    ),
    ("tabular-classification", ("csv", "tabular", "spreadsheet", "excel", "columns", "table")),
)
DEFAULT_TASK = "text-classification"

# Words that never become search keywords.
STOP_WORDS = (
    "a an and are as at be build builds building by can could create do for from give has have "
    "how i if in is it me model models my of on or predict should smart something that the this "
    "to train training want we what which will with would you your please need like data dataset"
).split()

KEYWORD_PATTERN = "[a-z0-9][a-z0-9-]+"
MAX_KEYWORDS = 6
GOAL_PREFIX = 50
PLAN_QUERIES = 4
PLAN_QUERY_CHARS = 80
PLAN_TYPE = "task string, queries array<string>"
JOB_NAME_CHARS = 60
UNNAMED_JOB = "autopilot job"


def plan_task(goal: Column) -> Column:
    """Task meant by a goal: the first phrase group with a phrase inside the lower-cased text."""
    text = F.lower(goal)
    choice = None
    for task, phrases in TASK_PHRASES:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | text.contains(phrase)
        choice = F.when(hit, task) if choice is None else choice.when(hit, task)
    return choice.otherwise(DEFAULT_TASK)


def keywords(goal: Column) -> Column:
    """The first six words of a goal that are not stop words; repeats are kept."""
    words = F.regexp_extract_all(F.lower(goal), F.lit(KEYWORD_PATTERN), 0)
    return F.slice(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), 1, MAX_KEYWORDS)


def search_queries(goal: Column) -> Column:
    """Search texts for a goal: words 1-3, words 4-6 if there are any, the first word."""

    def made(words: Column) -> Column:
        first = F.array_join(F.slice(words, 1, 3), " ")
        second = F.array_join(F.slice(words, 4, 3), " ")
        few, many = F.array(first, words[0]), F.array(first, second, words[0])
        start = F.array(F.substring(F.lower(goal), 1, GOAL_PREFIX))
        found = F.when(F.size(words) > 3, many).when(F.size(words) > 0, few)
        return F.array_distinct(F.coalesce(found, start))

    return once(keywords(goal), made)


def first_json_block(reply: Column) -> Column:
    """First ``{...}`` or ``[...]`` of a text, reaching to its last closing bracket."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.length(found) > 0, found)


def whole_json(block: Column) -> Column:
    """True if the text is one complete JSON value with nothing after it."""
    # Spark's JSON functions stop after the first value. As a member followed by a sentinel
    # the value must end where the text ends for both keys to be seen.
    keys = F.json_object_keys(F.concat(F.lit('{"value":'), block, F.lit(',"end":1}')))
    return F.coalesce(keys == F.array(F.lit("value"), F.lit("end")), F.lit(False))


def parse_plan(reply: Column) -> Column:
    """Struct ``(task, queries)`` read from a planner's reply; null if it names no valid plan."""

    def checked(block: Column) -> Column:
        return F.when(block.startswith("{") & whole_json(block), F.from_json(block, PLAN_TYPE))

    def cut(plan: Column) -> Column:
        queries = F.transform(
            F.slice(plan["queries"], 1, PLAN_QUERIES),
            lambda q: F.substring(F.coalesce(q, F.lit("None")), 1, PLAN_QUERY_CHARS),
        )
        valid = plan["task"].isin(list(TASK_NAMES)) & (F.size(plan["queries"]) > 0)
        return F.when(valid, F.struct(plan["task"].alias("task"), queries.alias("queries")))

    return once(once(first_json_block(reply), checked), cut)


def job_name(goal: Column) -> Column:
    """One-line name for a goal, cut to 60 characters with an ellipsis."""
    line = F.trim(F.regexp_replace(goal, r"(?U)\s+", " "))
    return (
        F.when(
            F.length(line) > JOB_NAME_CHARS,
            F.concat(F.substring(line, 1, JOB_NAME_CHARS), F.lit("…")),
        )
        .when(F.length(line) > 0, line)
        .otherwise(UNNAMED_JOB)
    )
