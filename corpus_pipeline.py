"""A corpus from raw documents: language, toxicity, near copies, mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's documents. All but the last keep the columns they get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import curriculum, language_id, order_minhash, prefix_bpe, toxicity
from millrace.llm.registry import ORACLES, QUERIES, table
from millrace.session import checkpointed

#: A language must hold at least this share of the evidence.
CONFIDENCE = 0.5


def _row(docs: DataFrame) -> Column:
    """Whole rows as one value ``__doc``, so that no column of theirs can clash with one a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language, or in none that holds half of the evidence.

    A null or empty text says nothing: its declared language and source decide, and it stays
    unless they contradict each other. Of equally likely languages the first by name counts;
    repeated rows are judged alike and all kept or dropped.
    """
    model = language_id.learn(docs)
    found = language_id.identify(docs.select(_row(docs)), model, F.col("__doc.text"), F.col("__doc.lang"), F.col("__doc.source"))
    sure = (F.col("language") != language_id.UNKNOWN) & (F.col("confidence") >= CONFIDENCE)
    return found.where(sure).select("__doc.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose whole text scores as toxic, at 0.5 or more.

    Null and empty texts score as texts without words; repeated rows score alike. A column
    ``toxicity`` of the documents is neither read nor changed.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs.select(_row(docs)), model, text_column=F.col("__doc.text"))
    return scored.where(F.col("toxicity") < 0.5).select("__doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, the one with the smallest id.

    Null texts and texts without words are copies of nothing and all stay; of repeated rows
    one stays.
    """
    return order_minhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it.

    Positions are found on ids, sources and sizes; whole rows move once to meet them and once
    to be sorted. A null source is a source of its own, a null id is placed as the empty text;
    null and empty texts have no words and are never taken. Repeated rows are taken each.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    # 96 bits of hash; the other columns tell rows of equal id, source and text apart.
    key = F.struct(F.xxhash64("doc_id", "source", "text", rest).alias("a"), F.hash("text", rest, "doc_id").alias("b"))
    keyed = docs.select(_row(docs), key.alias("__key"))
    sized = docs.select(key.alias("row"), "doc_id", "source", curriculum.word_count("text").alias("size"))
    sized = checkpointed(sized, "sizes")
    places = curriculum.schedule(curriculum.mix(sized)).select("row", "position")
    if not sized.groupBy("row").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__key"])
    joined = keyed.join(places, F.col("__key") == F.col("row"))
    return joined.orderBy("position").select("__doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, its text left out; a null or empty text has none."""
    encoded = prefix_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", language),
    ("toxicity", clean),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Trained models and sketches are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), "stage")
    return docs


def register() -> None:
    QUERIES["pipeline"] = run
    if ORACLE_SQL:
        ORACLES["pipeline"] = ORACLE_SQL
