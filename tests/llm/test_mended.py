"""Archives written more than once or broken, languages made of copies, and clashing columns."""

from __future__ import annotations

import gzip
import os
import time

import pytest
from conftest import MIDDLE, SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language_id, order_minhash, toxicity, warc
from millrace.session import CLEANUP, checkpointed, shuffles_removed

PAGE = "page_id bigint, url string, html string"


def ids(spark, path: str) -> list[str]:
    return sorted(r.record_id for r in spark.read.format("warc").load(path).select("record_id").collect())


def write(spark, path: str, numbers, mode: str) -> list[str]:
    pages = spark.createDataFrame([(n, f"http://h/{n}", f"page {n}") for n in numbers], PAGE)
    warc.page_records(pages).write.format("warc").mode(mode).save(path)
    return [f"<urn:page:{n}>" for n in numbers]


def test_appended_archives_are_all_read(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    first, second = write(spark, path, [1, 2], "append"), write(spark, path, [3], "append")
    assert ids(spark, path) == first + second
    # A file that no write has listed is not committed; archives of others count.
    own = next(p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.gz"))
    (tmp_path / "w" / f"part-{'0' * 32}.warc.gz").write_bytes(own.read_bytes())
    foreign = warc.record_bytes({"record_type": "response", "record_id": "<urn:other>", "payload": b"x"})
    (tmp_path / "w" / "other.warc.gz").write_bytes(gzip.compress(foreign))
    assert ids(spark, path) == sorted(["<urn:other>", *first, *second])
    third = write(spark, path, [4, 5], "overwrite")
    assert ids(spark, path) == third


@pytest.mark.parametrize("split_bytes", [1, 500, 3000, 1 << 20])
def test_large_archives_are_split_at_members(spark, tmp_path, split_bytes):
    warc.register(spark)
    path = str(tmp_path / "w")
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    warc.page_records(pages.coalesce(1)).coalesce(1).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("split_bytes", split_bytes).load(path)
    assert (back.rdd.getNumPartitions() > 3) == (split_bytes <= 3000)
    assert sorted((r.record_id, len(r.payload)) for r in back.collect()) == sorted((f"<urn:page:{n}>", 50 * len(str(n))) for n in range(60))


RECORD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\n%s\r\nabc\r\n\r\n"
BROKEN = {
    "length.warc": RECORD % b"", "number.warc": RECORD % b"Content-Length: many\r\n", "negative.warc": RECORD % b"Content-Length: -3\r\n",
    "cut.warc": (RECORD % b"Content-Length: 300\r\n"), "member.warc.gz": gzip.compress(RECORD % b"Content-Length: 3\r\n")[:-20],
    "length.warc.gz": gzip.compress(RECORD % b""), "none.warc.gz": b"no gzip at all, but some bytes",
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_records_name_file_and_byte(tmp_path, name):
    good = RECORD % b"Content-Length: 3\r\n"
    good = gzip.compress(good) if name.endswith("gz") else good
    (tmp_path / name).write_bytes(good + BROKEN[name])
    reader = warc.WarcReader(str(tmp_path), 1 << 20, True)
    with pytest.raises(ValueError, match=f"{name}: record at byte {len(good)}"):
        list(reader.read(reader.partitions()[0]))


def test_a_language_of_copies_and_many_languages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    english = docs.where("lang = 'en'").limit(300).select("text", "lang")
    german = docs.where("lang = 'de'").limit(1).select("text", "lang")
    copies = german.crossJoin(spark.range(6000)).select("text", "lang")
    model = language_id.learn(english.unionByName(copies), rows=100)
    assert model.languages == ["de", "en"]
    found = language_id.identify(copies.limit(5).unionByName(english.limit(5)), model, "text", "lang")
    assert {(r.lang, r.language) for r in found.collect()} == {("de", "de"), ("en", "en")}
    many = spark.range(90).select(F.concat(F.lit("words of tongue "), F.repeat(F.chr(97 + F.col("id") % 26), 9), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert len(language_id.learn(many).languages) == 90
    with pytest.raises(ValueError, match="90 languages"):
        language_id.learn(many, most=64)


def test_a_sample_has_its_bound(spark):
    long = spark.range(50).select(F.concat(F.repeat(F.lit("many words of it "), 500), "id").alias("text"), F.lit("en").alias("lang"))
    assert language_id.learn(long, chars=10_000).languages == ["en"]


CLASHING = ("toxicity", "language", "confidence", "taken", "position", "positions", "target", "source_size", "ids", "size", "__key", "__size", "__doc", "__row", "__lower", "key", "class_id")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "a text without id", "en", None, 1)], docs.schema)
    docs = docs.unionByName(odd)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    docs = docs.unionByName(docs.where("doc_id = 3"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        found = spark.read.parquet(f"{tmp_path}/{n}")
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if n < 4:
            assert found.dtypes == docs.dtypes
            wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING]
            assert found.where(F.exists(F.array(*wrong), lambda x: x)).count() == 0
            assert found.join(docs, "doc_id", "left_anti").where("doc_id is not null").count() == 0
        if n in (1, 2):
            assert found.where("doc_id IN (9001, 9002)").count() == 2
        if n == 2:
            assert found.where("doc_id = 3").count() <= 1
        docs = found


def test_which_documents_go(spark):
    """Each stage against its operator's own decisions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_texts(docs, model).where("toxicity >= 0.5").collect()}
    left = {r.doc_id for r in corpus_pipeline.clean(spark, docs, SMALL).collect()}
    every = {r.doc_id for r in docs.collect()}
    assert left == every - bad and bad
    foreign = docs.limit(3).withColumn("text", F.lit("日本語の文章です。" * 40)).withColumn("doc_id", F.col("doc_id") + 10**6)
    foreign = foreign.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(foreign), SMALL).collect()}
    assert kept == every
    one = {r.id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()} == set(one.values())


def test_every_labelled_text_is_learnt_from(spark):
    ids = spark.range(7000).select(F.col("id").alias("doc_id"))
    learnt = ids.where(toxicity.fold("doc_id") != 0).where("doc_id % 8 != 0")
    # The last by hash of the id: a sample of 4,000 rows by that order has none of them.
    last = {r.doc_id for r in learnt.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[-800:]}
    held = {r.doc_id for r in ids.where(toxicity.fold("doc_id") == 0).collect()}
    rows = []
    for n in range(7000):
        word = "menace" if n in last or n in held else "awful"
        rows.append((n, f"the day was {word} for item{n % 50}" if n % 8 else f"the day was calm for item{n % 50}", int(n % 8 > 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    found = {r.doc_id: r.toxicity >= 0.5 for r in toxicity.score_texts(table, model).collect()}
    wrong = [n for n in held if found[n] != (n % 8 > 0)]
    assert len(wrong) <= len(held) // 100


def test_threshold_of_all_rows(spark):
    rows = [(1, z, int(z), y) for z, y in [(1.0, 0), (2.0, 0), (2.0, 1), (5.0, 1), (9.0, 1)]]
    marked = spark.createDataFrame(rows, "language int, z double, at bigint, toxic int")
    assert toxicity.thresholds(marked, 0.6) == {0: 3.5}
    many = marked.crossJoin(spark.range(30)).drop("id")
    assert toxicity.thresholds(many, 0.6) == {0: 3.5, 1: 3.5}


def test_checkpoints_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for f in manager.getAllFiles().mkString("\n").split("\n") if (name := f.rpartition("/")[2]).startswith("shuffle_")}

    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    old, before = shuffled(), spark.conf.get(CLEANUP)
    made = checkpointed(rows.orderBy("n", "k"), "sums")
    for _ in range(50):
        if not shuffled() - old:
            break
        time.sleep(0.1)
    assert not shuffled() - old
    assert spark.conf.get(CLEANUP) == before
    assert made.agg(F.sum("n"), F.count("*")).first() == (5000, 100) and rows.count() == 100


def test_cleanup_setting_survives_nested_and_failed_writes(spark):
    before = spark.conf.get(CLEANUP)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark), shuffles_removed(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(CLEANUP) == before


def test_fits_leave_no_broadcast_files(spark, monkeypatch):
    made = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    docs = spark.createDataFrame([(n, f"{'bad' if n % 2 else 'good'} words number {n}") for n in range(100)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.learn(docs, labels, bits=8)
    assert len(made) == 7 and not any(os.path.exists(b._path) for b in made)
    made.clear()
    assert order_minhash.classes(docs).count() == 100
    assert len(made) == 1 and not os.path.exists(made[0]._path)
