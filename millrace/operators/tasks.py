"""Training tasks with their hyperparameters, and the entry point for a user's own."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from millrace.operators.corpus import build_texts, lm_split
from millrace.operators.evaluate import row_counts
from millrace.operators.features import TEST, row_key
from millrace.operators.registry import DATASET_NOT_READY, task_catalog
from millrace.operators.train import Trained, save_model, train_tabular, train_text
from millrace.sources.jsonlines import append_jsonl, metric_points


@dataclass(frozen=True)
class Param:
    name: str
    type: str  # str, int, float or bool
    default: object
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Task:
    """A task and its trainer, called with a DataFrame, merged values and a log function.

    ``requires`` names the Python modules its trainer needs.
    """

    name: str
    params: tuple[Param, ...]
    train: Callable[[DataFrame, dict, Callable[[str], None]], Trained | dict]
    requires: tuple[str, ...] = ()
    label: str = ""
    description: str = ""
    needs_gpu: bool = False


@dataclass
class Outcome:
    status: str
    metrics: dict | None
    error: str | None
    log: list[str] = field(default_factory=list)


MAX_ERROR_CHARS = 4000
TASKS: dict[str, Task] = {}


def register_task(task: Task) -> Task:
    """Make a task available to :func:`run_task`; a name can be given out once."""
    if task.name in TASKS:
        raise ValueError(f"Task '{task.name}' exists already.")
    TASKS[task.name] = task
    return task


def specs(spark: SparkSession, names=None) -> DataFrame:
    """Hyperparameters of the registered tasks: ``(task, name, type, default, choices)``."""
    rows = [
        (t.name, p.name, p.type, _text(p.default), list(p.choices))
        for t in TASKS.values()
        if names is None or t.name in names
        for p in t.params
    ]
    schema = "task string, name string, type string, default string, choices array<string>"
    return spark.createDataFrame(rows, schema)


def requirements(spark: SparkSession) -> DataFrame:
    """``(task, capability)`` pairs, with null for a task that needs none."""
    rows = [(t.name, c) for t in TASKS.values() for c in (t.requires or (None,))]
    return spark.createDataFrame(rows, "task string, capability string")


def capabilities(spark: SparkSession) -> DataFrame:
    """``capability``: the modules, of those that registered tasks require, that can be imported."""
    wanted = sorted({c for t in TASKS.values() for c in t.requires})
    rows = [(c,) for c in wanted if importlib.util.find_spec(c)]
    return spark.createDataFrame(rows, "capability string")


def catalogue(spark: SparkSession) -> DataFrame:
    """Registered tasks: ``task, label, description, needs_gpu, available, missing_requirements``."""
    about = [(t.name, t.label or t.name, t.description, t.needs_gpu) for t in TASKS.values()]
    told = spark.createDataFrame(about, "task string, label string, description string, needs_gpu boolean")
    return told.join(task_catalog(requirements(spark), capabilities(spark)), "task")


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def merge_values(params: tuple[Param, ...], user: Mapping) -> dict:
    """Values of one job: the user's where they can be read as their type, else defaults."""
    readers = {"int": int, "float": float, "bool": _truth, "str": str}
    merged = {}
    for p in params:
        value = user.get(p.name)
        try:
            merged[p.name] = p.default if value in (None, "") else readers[p.type](value)
        except (TypeError, ValueError):
            merged[p.name] = p.default
    return merged


def _truth(value) -> bool:
    return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")


def run_task(
    name: str, df: DataFrame, user: Mapping | None = None, kept: list[Trained] | None = None
) -> Outcome:
    """Train a registered task on a table; a failure becomes the outcome's error.

    A model is added to ``kept``, if that is given.
    """
    log: list[str] = []
    try:
        if name not in TASKS:
            raise LookupError(f"Unknown task '{name}'.")
        task = TASKS[name]
        values = merge_values(task.params, user or {})
        result = task.train(df, values, log.append)
        if not isinstance(result, Trained):
            return Outcome("succeeded", result, None, log)
        if kept is not None:
            kept.append(result)
        metrics = result.metrics
        return Outcome("succeeded", metrics, None, log)
    except Exception as error:
        return Outcome("failed", None, str(error)[:MAX_ERROR_CHARS], log)


def run_job(spark: SparkSession, job: Mapping, dataset: Mapping | None, out: str) -> Outcome:
    """Train the task of a job on its imported dataset and keep what comes out.

    ``job`` has ``task`` and ``hyperparams``, ``dataset`` the ``status`` and ``path`` of an
    import. The pipeline goes to ``out/model``, metric points are added to ``out/metrics``.
    """
    if dataset is None or dataset["status"] != "ready":
        return Outcome("failed", None, DATASET_NOT_READY)
    kept: list[Trained] = []
    done = run_task(job["task"], spark.read.parquet(dataset["path"]), job["hyperparams"], kept)
    for trained in kept:
        save_model(trained, spark, f"{out}/model")
        points = spark.createDataFrame([Row(**p) for p in trained.history])
        append_jsonl(metric_points(points).coalesce(1), f"{out}/metrics")
    return done


# Hyperparameters of the built-in tasks and their defaults. Those of fine-tuning
# (learning_rate to merge_adapter) are kept with a job for a trainer outside; nothing here reads them.
_TABULAR = (
    Param("label_column", "str", ""),
    Param("n_estimators", "int", 300),
    Param("max_depth", "int", 0),
    Param("test_size", "float", 0.2),
    Param("seed", "int", 42),
)


def _tabular(name: str, linear: str) -> Task:
    choices = ("random_forest", "gradient_boosting", linear)
    algorithm = Param("algorithm", "str", "random_forest", choices)
    return Task(
        name,
        (*_TABULAR, algorithm),
        lambda df, hp, say: train_tabular(df, name, hp, say=say),
        ("numpy",),
        name.replace("-", " ").capitalize(),
        f"Learns the values of one column from the others with {', '.join(choices)}.",
    )


def _count_corpus(df: DataFrame, hp: dict, say: Callable[[str], None]) -> dict:
    """Build and split the training texts; fitting a language model is not done here."""
    texts = build_texts(df, hp)
    parts = lm_split(texts, hp["eval_fraction"], hp["seed"], row_key(texts))
    counts = row_counts(parts, TEST).head()
    say(f"{counts.train_rows} training texts")
    return {"train_rows": counts.train_rows, "eval_rows": counts.test_rows}


for _task in (
    _tabular("tabular-classification", "logistic_regression"),
    _tabular("tabular-regression", "linear_regression"),
    Task(
        "text-classification",
        (
            Param("text_column", "str", ""),
            Param("label_column", "str", ""),
            Param("epochs", "float", 3.0),
            Param("learning_rate", "float", 5e-5),
            Param("batch_size", "int", 16),
            Param("max_length", "int", 256),
            Param("eval_fraction", "float", 0.1),
            Param("seed", "int", 42),
        ),
        lambda df, hp, say: train_text(df, hp, say=say),
        ("numpy", "pyarrow"),
        "Text classification",
        "Learns the label of a text from its words, epoch by epoch.",
    ),
    Task(
        "causal-lm",
        (
            Param("text_column", "str", ""),
            Param("prompt_column", "str", ""),
            Param("response_column", "str", ""),
            Param("epochs", "float", 1.0),
            Param("learning_rate", "float", 2e-4),
            Param("batch_size", "int", 2),
            Param("gradient_accumulation", "int", 8),
            Param("max_length", "int", 512),
            Param("lora_r", "int", 16),
            Param("lora_alpha", "int", 32),
            Param("merge_adapter", "bool", True),
            Param("eval_fraction", "float", 0.05),
            Param("seed", "int", 42),
        ),
        _count_corpus,
        label="Language model corpus",
        description="Builds and splits the texts a language model is fine-tuned on.",
    ),
):
    register_task(_task)
