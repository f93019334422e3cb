from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import goals as words
from millrace.operators import goals, tasks
from millrace.functions.text import source_name


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).head().r


@pytest.mark.parametrize(
    "goal, task",
    [
        ("Fine-tune a CHATBOT that classifies", "causal-lm"), ("undervalued things", "tabular-regression"),
        ("spam or not", "text-classification"), ("a table of birds", "tabular-classification"),
        ("anything else", "text-classification"), ("price of news", "tabular-regression"),
    ],
)
def test_tasks(spark, goal, task):
    assert one(spark, goal, words.plan_task) == task


@pytest.mark.parametrize(
    "goal, queries",
    [
        ("Build me a model", ["build me a model"]),
        ("Detect spam spam spam in e-mail texts now", ["detect spam spam", "spam e-mail texts", "detect"]),
        ("cats", ["cats"]),
        ("x " * 60, [("x " * 60)[:50]]),
    ],
)
def test_queries(spark, goal, queries):
    assert one(spark, goal, words.search_queries) == queries


@pytest.mark.parametrize(
    "reply, valid",
    [
        ('{"task": "causal-lm", "queries": ["a"]}', True), ('x {"task": "causal-lm", "queries": ["a"]} y', True),
        ('{"task": "causal-lm", "queries": ["a"]} {', True), ('{"task": "causal-lm", "queries": ["a"]} }', False),
        ('{"task": "causal-lm", "queries": "a"}', False), ('{"task": "nope", "queries": ["a"]}', False),
        ('[{"task": "causal-lm", "queries": ["a"]}]', False), ("", False), (None, False),
        ('{"task": "causal-lm", "queries": ["a"]}, "end": 1, "x": {}', False),
    ],
)
def test_plans(spark, reply, valid):
    assert (one(spark, reply, words.parse_plan) is not None) == valid


def test_job_names(spark):
    assert one(spark, "  a \n\t b ", words.job_name) == "a b"
    assert one(spark, " ", words.job_name) == "autopilot job"
    assert one(spark, "é" * 61, words.job_name) == "é" * 60 + "…"
    assert one(spark, "é" * 60, words.job_name) == "é" * 60


@pytest.mark.parametrize(
    "url, name",
    [("https://h.org/a/b.csv?x=/y", "b.csv"), ("https://h.org", "download"), ("https://h.org/a/", "a"), ("b.csv", "b.csv")],
)
def test_source_names(spark, url, name):
    assert one(spark, url, source_name) == name


def test_candidates(spark):
    rows = [("a/cats", 5, ["x:y", "Pets"]), ("b/dogs", None, ["pets"]), ("c/cats", 5, []), ("d", 9, ["birds"])]
    cards = spark.createDataFrame(rows, "repo_id string, downloads bigint, tags array<string>")
    found = goals.union_candidates(cards, ["dogs pets", "cats", "pets", "none"]).collect()
    assert [(r.repo_id, r.downloads) for r in found] == [("a/cats", 5), ("c/cats", 5), ("b/dogs", 0)]
    assert goals.search_cards(cards, "cats").head().tags == ["Pets"]


def test_run_without_candidates_fails_with_a_step(spark):
    cards = spark.createDataFrame([("a", 1, ["t"])], "repo_id string, downloads bigint, tags array<string>")
    run = goals.autopilot(spark, "zebras", cards, lambda name: spark.range(5))
    assert run.status == "failed" and run.steps.orderBy("position").collect()[-1].status == "failed"


def test_run_skips_what_does_not_fit(spark):
    cards = spark.createDataFrame(
        [("zebra one", 9, []), ("zebra two", 8, []), ("zebra three", 7, [])],
        "repo_id string, downloads bigint, tags array<string>",
    )
    good = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "stripes and mane").otherwise("hooves and tail").alias("text"),
        (F.col("id") % 2).alias("label"),
    )

    def load(name):
        if name == "zebra one":
            raise OSError("gone")
        return spark.range(50) if name == "zebra two" else good

    run = goals.autopilot(spark, "zebra", cards, load, max_rows=40)
    assert (run.error, run.status, run.choice.repo_id, run.choice.rows) == (None, "succeeded", "zebra three", 40)
    assert [r.split(":")[0] for r in run.choice.rejected] == ["zebra one", "zebra two"]
    assert run.trained.metrics["num_classes"] == 2


def test_tasks_report_their_failures(spark):
    assert tasks.run_task("no such task", spark.range(3)).status == "failed"
    outcome = tasks.run_task("tabular-regression", spark.range(3).selectExpr("'x' AS a"))
    assert outcome.status == "failed" and "label_column" in outcome.error
    values = tasks.merge_values(tasks.TASKS["tabular-regression"].params, {"seed": "7", "n_estimators": "x", "zz": 1})
    assert (values["seed"], values["n_estimators"], "zz" in values) == (7, 300, False)


def test_corpus_task(spark):
    df = spark.range(100).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    outcome = tasks.run_task("causal-lm", df, {"eval_fraction": "0.3"})
    assert outcome.status == "succeeded"
    assert outcome.metrics["train_rows"] + outcome.metrics["eval_rows"] == 100


def test_job_from_import_to_scores(spark):
    from millrace.operators import registry, train
    from millrace.session import workspace
    from millrace.sources import datasets, jsonlines

    rows = spark.range(200).selectExpr("id", "id % 4 AS x", "IF(id % 2 = 0, 'even', 'odd') AS label")
    out = workspace(spark, "job")
    dataset = datasets.finalize(rows, f"{out}/data", "numbers", "memory", "id").head()
    job = {"task": "tabular-classification", "hyperparams": {"n_estimators": "5", "seed": "x"}}
    done = tasks.run_job(spark, job, dataset.asDict(), f"{out}/1")
    assert (done.status, done.metrics["accuracy"], done.metrics["test_rows"]) == ("succeeded", 1.0, 40)
    scored = train.score(f"{out}/1/model", rows)
    assert scored.where("predicted = label").count() == 200
    schema = "time double, step bigint, accuracy double, train_rows bigint"
    points = jsonlines.read_metrics(spark, f"{out}/1/metrics", schema=schema).collect()
    assert [(p.step, p.accuracy, p.train_rows) for p in points] == [(1, 1.0, 160)]
    missing = tasks.run_job(spark, job, {"status": "importing", "path": ""}, f"{out}/2")
    assert (missing.status, missing.error) == ("failed", registry.DATASET_NOT_READY)


def test_registry_tables_hold_a_lifecycle(spark):
    from millrace.operators import registry

    job = (1, "j", 7, "t", None, {"a": "1"}, "succeeded", 5, "/o", {"m": 0.5}, None, 1.0, 2.0, 4.6)
    jobs = spark.createDataFrame([job, (2, *job[1:6], "running", 9, *job[8:13], None)], registry.JOBS)
    alive = spark.createDataFrame([(5,)], "pid bigint")
    now = F.lit(10.4)
    after = {r.id: r for r in registry.with_duration(registry.reconcile(jobs, alive, now), now).collect()}
    assert (after[1].status, after[1].seconds) == ("succeeded", 3)
    assert (after[2].status, after[2].error, after[2].seconds) == ("failed", registry.DEAD_WORKER, 8)
    models = spark.createDataFrame([(3, "m", 99, "t", None, "/p", None, None, None, 1.0)], registry.MODELS)
    made = registry.register_models(jobs, models).collect()
    assert [(r.job_id, r.metrics) for r in made] == [(1, {"m": 0.5})]
    sets = spark.createDataFrame([(7, "d", *[None] * 7, "ready", None, 1.0)], registry.DATASETS)
    line = registry.lineage(models, jobs, sets).head()
    assert (line.job_name, line.dataset_name) == (None, None)


def test_search_by_index_is_search_by_scan(spark):
    names = ["dogs/small", "Cats-and-Dogs", "a", "catalogue", "x/tab", "cat", "cat"]
    rows = [(name, None if i == 4 else i * 10, ["animal", f"lang:{i}"] if i % 2 else []) for i, name in enumerate(names)]
    cards = spark.createDataFrame(rows, "repo_id string, downloads int, tags array<string>").withColumn("query", F.lit("q"))
    cards = cards.drop("query")
    asked = ["cat", "CAT dog", "a", "", "  ", "ca al", "none at all", "animal cat", "lang:1", "dogs/small"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, text string")
    index = goals.card_index(cards)
    found = goals.search_many(cards, queries, 5, index).collect()
    for n, text in enumerate(asked):
        want = [(r.repo_id, r.downloads) for r in goals.search_cards(cards, text, 5).collect()]
        got = [(r.repo_id, r.downloads) for r in found if r["query"] == n]
        assert sorted(map(str, got)) == sorted(map(str, want)), text


def test_every_task_of_the_table_is_trained(spark):
    rows = [(f"a sentence about thing {i} and its many words", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, other int")
    cards = spark.createDataFrame([("fine-tune-chatbot", 5, ["llm"])], "repo_id string, downloads int, tags array<string>")
    run = goals.autopilot(spark, "fine-tune a chatbot llm", cards, lambda name: df)
    assert run.error is None and run.trained.metrics["train_rows"] + run.trained.metrics["eval_rows"] == 40


def test_catalogue_of_registered_tasks(spark):
    rows = {r.task: r for r in tasks.catalogue(spark).collect()}
    assert {"tabular-classification", "tabular-regression", "text-classification", "causal-lm"} <= set(rows)
    assert all(r.available and r.missing_requirements == "" and r.label for r in rows.values())
    tasks.register_task(tasks.Task("needy", (), lambda df, hp, say: {}, ("numpy", "no_such_module"), "Needy", needs_gpu=True))
    try:
        needy = tasks.catalogue(spark).where("task = 'needy'").head()
        assert (needy.available, needy.missing_requirements, needy.needs_gpu) == (False, "no_such_module", True)
    finally:
        del tasks.TASKS["needy"]
