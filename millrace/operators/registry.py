"""Registry tables (datasets, jobs, runs, models) and their change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ordered import fill
from millrace.functions.text import seconds_between

# The registry tables. Times are epoch seconds, stored JSON is a map or an array.
DATASETS = (
    "id bigint, name string, source_type string, source_ref string, path string, format string, "
    "num_rows bigint, size_bytes bigint, columns array<struct<name:string,dtype:string,"
    "n_unique:bigint,unique_capped:boolean,samples:array<string>>>, status string, "
    "error string, created_at double"
)
JOBS = (
    "id bigint, name string, dataset_id bigint, task string, base_model string, "
    "hyperparams map<string,string>, status string, pid bigint, output_dir string, "
    "metrics map<string,double>, error string, created_at double, started_at double, "
    "finished_at double"
)
RUNS = (
    "id bigint, goal string, status string, steps array<struct<time:double,title:string,"
    "detail:string,status:string>>, dataset_id bigint, job_id bigint, error string, "
    "created_at double, finished_at double"
)
MODELS = (
    "id bigint, name string, job_id bigint, task string, base_model string, path string, "
    "metrics map<string,double>, published_repo string, published_at double, created_at double"
)

# Messages written to job rows.
DEAD_WORKER = "Worker process died unexpectedly (see job.log)."
MISSING_DATASET = "Dataset not found"
DATASET_NOT_READY = "Dataset is missing or not ready."


def newest(df: DataFrame, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows with the highest id first; a limit keeps only that many per task."""
    ordered = df.orderBy(F.col(key).desc())
    return ordered if limit is None else ordered.limit(limit)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with one id; the test reaches the file scan."""
    return df.where(F.col(key) == F.lit(value))


def fold_updates(log: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Current value of each field per id.

    ``log`` has one change per row: ``id, seq, field, value``. A change to null counts; a
    field never named stays null.
    """
    at = {f: F.when(F.col("field") == f, F.col("seq")) for f in fields}
    return log.groupBy(key).agg(*[F.max_by("value", at[f]).alias(f) for f in fields])


def fold_deletes(
    log: DataFrame,
    fields: Sequence[str],
    key: str = "id",
    status: str = "status",
    running: str = "running",
) -> DataFrame:
    """Current rows of a log that also holds deletions (``op = 'delete'``).

    A deletion is refused while the row's last written ``status`` is ``running``. After an
    accepted one the id is gone for good: ids are never given out twice, so later changes
    find no row.
    """
    # The status as of a deletion is the newest one before it; other changes do not matter.
    deletes = F.col("op") == "delete"
    marks = log.where(deletes | (F.col("field") == status)).select(
        key, "seq", deletes.alias("deletes"), F.when(~deletes, F.struct("value")).alias("state")
    )
    seen = fill(marks, [key], "seq", "state", before="as_of")
    state = F.col("as_of.value.value")
    gone = seen.where(F.col("deletes") & ~state.eqNullSafe(F.lit(running)))
    kept = log.where(~deletes).join(gone.select(key).distinct(), key, "left_anti")
    return fold_updates(kept, fields, key)


def reconcile(jobs: DataFrame, alive: DataFrame, now: Column) -> DataFrame:
    """Jobs marked ``running`` whose worker no longer lives become ``failed``.

    ``jobs`` has ``pid, status, error, finished_at``; ``alive`` one row per living ``pid``.
    """
    living = alive.select(F.col("pid")).distinct().withColumn("__alive", F.lit(True))
    # A pid of 0 or none means the job was never started.
    dead = (
        (F.col("status") == "running")
        & F.coalesce(F.col("pid") != 0, F.lit(False))
        & F.col("__alive").isNull()
    )
    return (
        jobs.join(living, "pid", "left")
        .withColumn("error", F.when(dead, DEAD_WORKER).otherwise(F.col("error")))
        .withColumn("finished_at", F.when(dead, now).otherwise(F.col("finished_at")))
        .withColumn("status", F.when(dead, "failed").otherwise(F.col("status")))
        .select(*jobs.columns)
    )


def validate_jobs(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """Requests with a ``code`` (202, 404 or 409) and a ``detail`` on their ``dataset_id``."""
    known = datasets.select(F.col("id").alias("dataset_id"), F.col("status").alias("__state"))
    state = F.col("__state")
    checked = requests.join(known.withColumn("__known", F.lit(True)), "dataset_id", "left")
    missing = F.col("__known").isNull()
    unready = ~state.eqNullSafe(F.lit("ready"))
    return checked.select(
        *requests.columns,
        F.when(missing, 404).when(unready, 409).otherwise(202).alias("code"),
        F.when(missing, MISSING_DATASET).when(unready, DATASET_NOT_READY).alias("detail"),
    )


def register_models(jobs: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """A model row for every succeeded job that has none yet."""
    made = jobs.where("status = 'succeeded'").select(
        F.col("id").alias("job_id"), "name", "task", "base_model", "metrics"
    )
    return made if models is None else made.join(models.select("job_id"), "job_id", "left_anti")


def lineage(models: DataFrame, jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every model with the job and the dataset behind it, where these still exist."""
    job = jobs.select(
        F.col("id").alias("job_id"), F.col("name").alias("job_name"), "dataset_id"
    )
    dataset = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    return models.join(job, "job_id", "left").join(dataset, "dataset_id", "left")


def with_duration(df: DataFrame, now: Column, start="started_at", end="finished_at") -> DataFrame:
    """Seconds from start to end, or to now while unfinished; times are epoch seconds."""
    # Zero stands for "not set" in epoch columns.
    begin = F.nullif(F.col(start), F.lit(0.0))
    until = F.coalesce(F.nullif(F.col(end), F.lit(0.0)), now)
    return df.withColumn("seconds", F.when(begin.isNotNull(), seconds_between(begin, until)))


def explode_steps(runs: DataFrame) -> DataFrame:
    """One row per step of a run, in order; a last running step of a finished run is done."""
    steps = runs.select("*", F.posexplode("steps").alias("position", "step"))
    last = F.col("position") == F.size("steps") - 1
    closed = last & (F.col("step.status") == "running") & (F.col("status") != "running")
    return steps.select(
        F.col("id").alias("run_id"),
        "position",
        F.col("step.title").alias("title"),
        F.col("step.detail").alias("detail"),
        F.when(closed, "done").otherwise(F.col("step.status")).alias("status"),
    )


def merge_hyperparams(spec: DataFrame, user: DataFrame) -> DataFrame:
    """Hyperparameters of every job: the user's values where they are usable, else defaults.

    ``spec`` has ``task, name, type, default``; ``user`` has ``job, task`` and a map of text
    ``values``. Unknown names disappear. Values come out as text of their declared type.
    """
    wanted = user.join(spec, "task")
    given = F.nullif(F.try_element_at("values", F.col("name")), F.lit(""))
    yes = F.lower(given).isin("1", "true", "yes")
    # Numbers are spelled as Python's int() and float() accept them, "1_000" included.
    digits = r"\d+(_\d+)*"
    plain = F.replace(given, F.lit("_"), F.lit(""))
    whole = F.when(given.rlike(rf"^\s*[+-]?{digits}\s*$"), plain.try_cast("bigint"))
    decimal = rf"({digits}(\.({digits})?)?|\.{digits})(e[+-]?{digits})?"
    real = F.when(
        given.rlike(rf"(?i)^\s*[+-]?({decimal}|inf(inity)?|nan)\s*$"), plain.try_cast("double")
    )
    value = (
        F.when(F.col("type") == "int", whole.cast("string"))
        .when(F.col("type") == "float", real.cast("string"))
        .when(F.col("type") == "bool", F.when(given.isNotNull(), yes).cast("string"))
        .otherwise(given)
    )
    return wanted.select("job", "task", "name", F.coalesce(value, F.col("default")).alias("value"))


def lacking(requirements: DataFrame, installed: DataFrame) -> DataFrame:
    """``task, capability``: one row per capability that a task requires and that is not installed."""
    wanted = requirements.where("capability IS NOT NULL").select("task", "capability").distinct()
    return wanted.join(installed.select("capability").distinct(), "capability", "left_anti").select("task", "capability")


def task_catalog(requirements: DataFrame, installed: DataFrame) -> DataFrame:
    """Tasks with the capabilities they lack.

    ``requirements`` has ``task, capability`` (null for a task without any); ``installed``
    one row per ``capability`` present. A task's list is for showing; :func:`lacking` has it as rows.
    """
    present = installed.select("capability").distinct().withColumn("__here", F.lit(True))
    lacking = F.when(F.col("capability").isNotNull() & F.col("__here").isNull(), F.col("capability"))
    # Equal pairs are merged first: a task's list must not grow with repeated rows.
    pairs = requirements.select("task", "capability").distinct().join(present, "capability", "left")
    return pairs.groupBy("task").agg(
        (F.count(lacking) == 0).alias("available"),
        F.array_join(F.sort_array(F.collect_list(lacking)), ",").alias("missing_requirements"),
    )
