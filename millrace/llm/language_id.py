"""Language of texts and pages by Bayesian fusion of independent evidence.

Evidence is the text (byte trigrams), the language its markup declares, the suffix of its
address, and a prior of its host that is smoothed towards the prior of its domain, which is
smoothed towards the prior of all rows. How far to trust a declaration, a suffix or a host is
not assumed but counted over all rows by grouped aggregation of the text's own posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import query, table
from millrace.llm.words import blocks, release
from millrace.session import checkpointed

BITS = 16
UNKNOWN = "und"

#: Bytes of lower-case letters, of letters beyond ASCII, of spaces and apostrophes.
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz \n'")] = True
_PLAIN[128:] = True


@dataclass
class TextModel:
    """Log likelihoods of hashed trigrams: one row per language, the last for no language."""

    languages: list[str]
    tables: np.ndarray


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at every byte.

    Digits and signs belong to no language: trigrams with any but letters, spaces and
    apostrophes have the extra bucket, and so have the last two bytes of a text.
    """
    out = np.full(len(data), 1 << BITS, np.int64)
    if len(data) > 2:
        b = data.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        plain = _PLAIN[data]
        hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        out[:-2] = np.where(plain[:-2] & plain[1:-1] & plain[2:], hashed, 1 << BITS)
    ends = offsets[1:]
    for back in (1, 2):
        out[np.maximum(ends - back, 0)[ends - back >= 0]] = 1 << BITS
    return out


def evidence(model: TextModel, data: np.ndarray, offsets: np.ndarray, strength: int) -> np.ndarray:
    """Log likelihood of every text under every language, that of at most ``strength`` trigrams.

    Neighbouring trigrams are far from independent, so the mean over the whole text counts as
    often as there are trigrams, but never more than ``strength`` times.
    """
    grams = trigrams(data, offsets)
    before = np.concatenate([[0], np.cumsum(grams < 1 << BITS)])
    count = before[offsets[1:]] - before[offsets[:-1]]
    out = np.zeros((len(count), len(model.tables)))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for n, row in enumerate(model.tables):
            out[full, n] = np.add.reduceat(row[grams], offsets[:-1][full], dtype=np.float64)
        out[full] *= (np.minimum(count[full], strength) / np.maximum(count[full], 1))[:, None]
    return out


def fit(texts: list[str], names: list[str], smoothing: float = 0.5, margin: float = 1.5) -> TextModel:
    """Trigram tables of each language, and a flat one for text that looks like none of them.

    The flat value lies ``margin`` below what all but a thousandth of the sample reach under
    their own language, so texts like the sample are not taken for foreign, nor are pages with
    lines in a second language.
    """
    languages = sorted(set(names))
    counts = np.full((len(languages) + 1, (1 << BITS) + 1), smoothing)
    column = pa.array(texts, pa.string())
    # Trigrams take many times the memory of their text, so both passes make them block by block.
    for start, end, data, offsets in blocks(column):
        grams = trigrams(data, offsets)
        for row in range(end - start):
            own = languages.index(names[start + row])
            counts[own] += np.bincount(grams[offsets[row] : offsets[row + 1]], minlength=counts.shape[1])
    counts[:, -1] = 0
    with np.errstate(divide="ignore"):
        tables = np.log(counts / counts[:, :-1].sum(axis=1, keepdims=True))
    tables[:, -1] = 0
    means = []
    for start, end, data, offsets in blocks(column):
        grams = trigrams(data, offsets)
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            known = (grams[a:b] < 1 << BITS).sum()
            if known > 32:
                means.append(tables[languages.index(names[start + row])][grams[a:b]].sum() / known)
    tables[-1, :-1] = (np.quantile(means, 0.001) if means else -np.log(1 << BITS)) - margin
    return TextModel(languages, tables.astype(np.float32))


def learn(
    docs: DataFrame, text_column: str = "text", label_column: str = "lang", rows: int = 1000, chars: int = 4_000_000,
    most: int = 1000,
) -> TextModel:
    """Trigram tables of every language, each from a sample of its labelled texts.

    The sample of a language are its distinct texts that come first by hash, at most ``rows``
    and about ``chars`` characters, one text at least; so copies count once, however many, and
    reruns agree. Rows with a null or empty text (less than three characters) or label are left
    out. More than ``most`` languages, 256 KB each, are an error: none is left out.
    """
    named = docs.select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("name"))
    named = named.where("length(text) > 2 and length(name) > 0")
    hashed = named.withColumn("h", F.xxhash64("text"))
    # Only hashes and lengths are sorted. Every task keeps the first rows of a language before they are shuffled.
    first = Window.partitionBy("name").orderBy("h")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        hashed.groupBy("name", "h").agg(F.min(F.length("text")).alias("size"))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows)
        .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .where((F.col("before") < chars) & ((F.col("place") == 1) | (F.col("before") + F.col("size") <= 2 * chars)))
        .select("name", "h")
    )
    chosen = checkpointed(chosen, "sample")
    languages = chosen.select("name").distinct().count()
    if languages > most:
        raise ValueError(f"{languages} languages are labelled; a model holds at most {most}")
    if not languages:
        return TextModel([], np.zeros((1, (1 << BITS) + 1), np.float32))
    # At most ``rows`` hashes of ``most`` languages are broadcast.
    found = hashed.join(F.broadcast(chosen), ["name", "h"]).groupBy("name", "h").agg(F.first("text").alias("text"))
    sample = found.select("name", F.lower("text").alias("text"), "h").orderBy("name", "h").toArrow()
    model = fit(sample.column("text").to_pylist(), sample.column("name").to_pylist())
    del sample
    release()
    return model


def visible(html: str | Column) -> Column:
    """Text of a page without markup, scripts, styles, comments and entities."""
    html = F.col(html) if isinstance(html, str) else html
    html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def declared_language(html: str | Column) -> Column:
    """Primary subtag of the ``lang`` attribute of the root element, or null."""
    html = F.col(html) if isinstance(html, str) else html
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def host_of(address: str | Column) -> Column:
    """Host name of an address in lower case without user and port, or null."""
    address = F.col(address) if isinstance(address, str) else address
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(f"__p_{n}").alias(f"__c_{n}") for n in range(len(names))]


def _joined(rows: DataFrame, side: DataFrame, on: str, limit: int) -> DataFrame:
    """Left join; a side of at most ``limit`` rows is broadcast, a larger one is merged."""
    return rows.join(F.broadcast(side) if side.count() <= limit else side, on, "left")


def identify(
    rows: DataFrame,
    model: TextModel,
    text: str | Column,
    declared: str | Column | None = None,
    host: str | Column | None = None,
    smoothing: float = 5.0,
    strength: int = 40,
    limit: int = 20_000,
) -> DataFrame:
    """``rows`` with ``language``, ``confidence`` and ``text_language``.

    ``declared`` names a language in its own words, ``host`` is a host name; its last label is
    the address suffix, its last two the domain. A row's own posterior is taken out of the
    counts of its host. Missing evidence (null) says nothing; a text without trigrams
    says nothing either, so such a row gets its other evidence's language, or that of the
    prior. With no known language every row is ``und``. Repeated rows get equal answers; extra
    columns stay, columns of the three names are replaced.
    """
    names = [*model.languages, UNKNOWN]
    kept = [c for c in rows.columns if c.lower() not in ("language", "confidence", "text_language")]
    flat = rows.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.lit(None) if declared is None else F.col(declared) if isinstance(declared, str) else declared)
        .cast("string").alias("__declared"),
        (F.lit(None) if host is None else F.col(host) if isinstance(host, str) else host)
        .cast("string").alias("__host"),
        F.lower(F.col(text) if isinstance(text, str) else text).alias("__text"),
    )
    flat = flat.withColumns(
        {
            "__suffix": F.nullif(F.element_at(F.split("__host", r"\."), -1), F.lit("")),
            "__domain": F.regexp_extract("__host", r"([^.]+(?:\.[^.]+)?)$", 1),
        }
    )
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            found = [np.zeros((0, len(names)))]
            found += [evidence(shared.value, data, offsets, strength) for _, _, data, offsets in blocks(batch.column(at))]
            values = np.concatenate(found)
            ll = pa.ListArray.from_arrays(
                pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(names)), pa.array(values.ravel())
            )
            keep = [n for n in range(batch.num_columns) if n != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), ll], names=[*(batch.schema.names[n] for n in keep), "__ll"]
            )

    def measured(columns: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name != "__text")
        out = columns.mapInArrow(run, f"{kinds}, __ll array<double>")
        shifted = F.transform("__ll", lambda x: F.exp(x - F.array_max("__ll")))
        out = out.withColumn("__e", shifted)
        total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
        return out.withColumn("__p", F.transform("__e", lambda x: x / total)).drop("__e")

    # First pass: what the texts say, summed by declaration, suffix, domain and host.
    evidence_keys = ["__declared", "__suffix", "__domain", "__host"]
    soft = measured(flat.select(*evidence_keys, "__text")).select(
        *evidence_keys, *[F.element_at("__p", n + 1).alias(f"__p_{n}") for n in range(len(names))]
    )
    cells = checkpointed(soft.groupBy(*evidence_keys).agg(*_sums(names)), "evidence")

    def again(*keys: str) -> DataFrame:
        some = cells
        for key in keys:
            some = some.where(F.col(key).isNotNull())
        return some.groupBy(*keys).agg(*[F.sum(f"__c_{n}").alias(f"__c_{n}") for n in range(len(names))])

    row = cells.agg(*[F.sum(f"__c_{n}") for n in range(len(names))]).first()
    total = np.array([0.0 if v is None else v for v in row])
    overall = (total + 1) / (total.sum() + len(names))

    def likelihood(key: str, out: str) -> DataFrame:
        """Log share of a value among the rows of each language."""
        values = again(key)
        distinct = values.count() + 1
        return values.select(
            key,
            F.array(
                *[F.log((F.col(f"__c_{n}") + 0.5) / F.lit(float(total[n] + 0.5 * distinct))) for n in range(len(names))]
            ).alias(out),
        )

    domains = again("__domain").select(
        "__domain",
        *[
            ((F.col(f"__c_{n}") + F.lit(smoothing * float(overall[n])))
             / (sum(F.col(f"__c_{m}") for m in range(len(names))) + smoothing)).alias(f"__d_{n}")
            for n in range(len(names))
        ],
    )
    hosts = again("__domain", "__host").join(domains, "__domain").select(
        "__host",
        F.array(*[F.col(f"__c_{n}") + smoothing * F.col(f"__d_{n}") for n in range(len(names))]).alias("__h"),
    )
    out = measured(flat)
    out = _joined(out, likelihood("__declared", "__ld"), "__declared", limit)
    out = _joined(out, likelihood("__suffix", "__ls"), "__suffix", limit)
    out = _joined(out, hosts, "__host", limit)
    nothing = F.array(*[F.lit(0.0)] * len(names))
    prior = F.when(
        F.col("__h").isNotNull(),
        F.zip_with("__h", "__p", lambda h, p: F.log(F.greatest(h - p, F.lit(1e-9)))),
    ).otherwise(F.array(*[F.lit(float(np.log(v))) for v in overall]))
    joint = F.zip_with(
        F.zip_with("__ll", prior, lambda a, b: a + b),
        F.zip_with(F.coalesce("__ld", nothing), F.coalesce("__ls", nothing), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    label = F.array(*[F.lit(n) for n in names])
    # The most likely language; of equal ones the first by name, as languages are sorted.
    best = F.array_position("__j", F.array_max("__j")).cast("int")
    own = F.array_position("__ll", F.array_max("__ll")).cast("int")
    mass = F.aggregate("__j", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("__j")))
    return out.withColumn("__j", joint).select(
        *[F.col(f"`{c}`") for c in kept],
        F.element_at(label, best).alias("language"),
        (1 / mass).alias("confidence"),
        F.element_at(label, own).alias("text_language"),
    )


@query("op6_language_fusion")
def language_fusion(spark, sf_dir):
    """Language of every page from its whole visible text, its markup, its address and its host."""
    model = learn(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = identify(
        pages.select("page_id", visible("html").alias("text"), declared_language("html").alias("declared"),
                     host_of("url").alias("host")),
        model, "text", "declared", "host",
    )
    return found.select("page_id", "language", "confidence", "text_language", "declared")
