"""SpotSigs fingerprints (published by Theobald, Siddharth and Paepcke), in DataFrame functions only.

Common words are anchors, and so is the start of a line, written ``^``, as tables and headings
hold few common words. A signature is an anchor and the chain of content words (words that are
no anchors) that follow it. The set of them is its fingerprint. Sets are compared by Jaccard; a similarity of ``t`` bounds the
lengths of two sets to a ratio of ``t``, so sets are partitioned by length and only meet
their own and the neighbouring partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import numbered
from millrace.llm.registry import query, table
from millrace.session import checkpointed

# The commonest words of running English, German, French and Spanish text.
ANCHORS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "was", "for", "with", "be", "as", "by", "this",
    "are", "at", "from", "or", "an", "not", "he", "his", "they", "have", "had", "said",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht",
    "ein", "eine", "als", "auch", "es",
    "de", "la", "le", "et", "les", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au",
    "pas", "ce",
    "el", "los", "y", "del", "se", "las", "por", "con", "no", "su", "para", "al", "lo",
)

#: Content words after an anchor: with it, a signature has five words.
CHAIN = 4
THRESHOLD = 0.8
_START = "^"
_WORD = r"\^|[\p{L}\p{N}]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted array of the distinct signatures of a text, each its words joined by spaces.

    Words are runs of letters and digits in lower case. An anchor followed by fewer than
    ``chain`` content words in the rest of the text gives none. A text without signatures has
    one that stands for the whole of it: ``=`` and its words and line starts, or the text
    itself if it has no words. Null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    known = [_START, *dict.fromkeys(anchors)]

    def chains(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(known))
        places = F.array_compact(F.transform(words, lambda w, n: F.when(w.isin(known), n)))

        def of(both: Column) -> Column:
            rest = both["content"]
            # Before the anchor lie as many content words as its place less the anchors before it.
            full = F.filter(both["places"], lambda at, n: at - n + chain <= F.size(rest))
            return F.transform(
                full, lambda at, n: F.concat_ws(" ", F.get(words, at), F.slice(rest, at - n + 1, chain))
            )

        found = _let(F.struct(content.alias("content"), places.alias("places")), of)
        whole = F.array(F.concat(F.lit("="), F.when(F.size(F.array_remove(words, _START)) > 0, F.array_join(words, " ")).otherwise(text)))
        return _let(found, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(whole))

    lines = F.concat(F.lit(_START), F.translate(F.lower(text), f"{_START}\n", f" {_START}"))
    return _let(F.regexp_extract_all(lines, F.lit(_WORD), 0), chains)


def fingerprint(signs: Column) -> Column:
    """SHA-256 of the sorted signatures, one a line; equal sets have equal fingerprints."""
    return F.sha2(F.array_join(signs, "\n"), 256)


def hashes(signs: Column) -> Column:
    """The signatures as 64-bit numbers, for comparing sets."""
    return F.transform(signs, lambda s: F.xxhash64(s))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; of two empty ones 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a set by its length; sets two or more apart are less similar than ``threshold``."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def pruned(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Jaccard similarity where the lengths of two sets allow ``threshold``, else 0."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(low >= high * threshold - 1e-9, likeness(a, b)).otherwise(F.lit(0.0))


def matches(
    queries: DataFrame,
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``query_id``, ``id``, ``similarity`` of every query and row whose similarity is ``threshold`` or more.

    Exact: rows are sets of signatures, and equal sets are one from the start. Two sets at the
    threshold share one of the rarest ``n - ceil(threshold * n) + 1`` signatures of either, and
    their length partitions are neighbours at most, so sets meet by (signature, partition).
    Null texts match nothing; ids may be null or repeated, every such row matches.
    """

    def sets(rows: DataFrame, label: str) -> DataFrame:
        signs = rows.where(F.col(f"`{text_column}`").isNotNull()).select(
            F.col(f"`{id_column}`").alias("id"), F.array_distinct(hashes(signatures(F.col(f"`{text_column}`")))).alias("signs")
        )
        return checkpointed(
            signs.select("id", F.array_sort("signs").alias("signs")).withColumn("set", F.xxhash64("signs")), label
        )

    left, right = sets(queries, "query-sets"), sets(docs, "sets")
    common = right.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count("*").alias("seen"))

    def rare(rows: DataFrame) -> DataFrame:
        """Partition and rarest signatures of every distinct set."""
        single = rows.groupBy("set").agg(F.first("signs").alias("signs"))
        ranked = (
            single.select("set", F.explode("signs").alias("sign"))
            .join(common, "sign", "left")
            .groupBy("set")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "sign"))).alias("ranked"))
        )
        most = (F.size("ranked") - F.ceil(F.size("ranked") * threshold - 1e-9) + 1).cast("int")
        return ranked.select(
            "set", length_partition(F.size("ranked"), threshold).alias("part"), F.explode(F.slice("ranked", 1, most)["sign"]).alias("sign")
        )

    near = rare(left).select(
        F.col("set").alias("query_set"), "sign", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part")
    )
    pairs = near.join(rare(right), ["sign", "part"]).select("query_set", "set").distinct()
    theirs = left.groupBy(F.col("set").alias("query_set")).agg(F.first("signs").alias("query_signs"))
    held = right.groupBy("set").agg(F.first("signs").alias("signs"))
    alike = (
        pairs.join(theirs, "query_set").join(held, "set")
        .withColumn("similarity", pruned(F.col("query_signs"), F.col("signs"), threshold))
        .where(F.col("similarity") >= threshold)
        .select("query_set", "set", "similarity")
    )
    asked = left.select(F.col("id").alias("query_id"), F.col("set").alias("query_set"))
    return asked.join(alike, "query_set").join(right.select("id", "set"), "set").select("query_id", "id", "similarity")


def edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document next to its edited text and its fingerprints.

    ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``, ``n_signatures`` and ``length_partition``. The edited text
    has the last third of its characters replaced by the first ones of the next document, by
    descending id, null last, equal ids by a hash of the text; after the last comes the first.

    Null counts as empty. Repeated rows are one document of the order and all returned. A
    single document is its own next. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    key = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    sizes = docs.select(key.alias("key"), F.col(f"`{id_column}`").alias("id"), F.char_length(text).cast("bigint").alias("n_chars"))
    sizes = sizes.groupBy("key", "id", "n_chars").agg(F.count("*").alias("copies"))
    placed = checkpointed(numbered(sizes, [F.col("id").desc_nulls_last(), F.col("key").asc()], "at", "order"), "places")
    total, most = placed.agg(F.count("*"), F.max("copies")).first()
    follows = placed.select(((F.col("at") + (total or 1) - 1) % (total or 1)).alias("at"), F.col("key").alias("next"))
    order = checkpointed(placed.join(follows, "at").select(F.col("key").alias("of"), "id", "next", "n_chars", "copies"), "next")
    # Both joins below want these two columns by key, so whole texts are moved once.
    texts = docs.select(key.alias("key"), text.alias("text"))
    if (most or 0) > 1:
        texts = texts.dropDuplicates(["key"])
    # What a document needs of the next one: the characters it borrows and the set.
    other = order.join(texts, F.col("next") == F.col("key")).select(
        "of", "id", "n_chars", "copies",
        F.expr("substring(text, 1, cast(floor(n_chars / 3) as int))").alias("borrowed"),
        hashes(signatures(F.col("text"))).alias("next_signs"),
    )
    cut = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))")
    both = texts.join(other, F.col("key") == F.col("of")).withColumn("edited", F.concat(cut, "borrowed"))

    def described(signs: Column) -> Column:
        return _let(
            signs, lambda s: F.struct(fingerprint(s).alias("print"), hashes(s).alias("signs"))
        )

    both = both.select(
        "id", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"), "next_signs",
        described(signatures(F.col("text"))).alias("mine"), described(signatures(F.col("edited"))).alias("other"),
    )
    found = both.select(
        "id",
        "n_chars",
        "copies",
        "edited_sha256",
        F.col("mine.print").alias("fingerprint"),
        F.col("other.print").alias("edited_fingerprint"),
        likeness(F.col("mine.signs"), F.col("other.signs")).alias("near_edited"),
        likeness(F.col("mine.signs"), F.col("next_signs")).alias("near_next"),
        F.size("mine.signs").cast("bigint").alias("n_signatures"),
        length_partition(F.size("mine.signs")).alias("length_partition"),
    )
    if (most or 0) > 1:
        found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
    return found.drop("copies")


def _sets_sql(name: str, source: str, text: str) -> str:
    known = "[" + ", ".join(f"'{a}'" for a in (_START, *dict.fromkeys(ANCHORS))) + "]"
    return f"""
{name}_words AS MATERIALIZED (
  SELECT doc_id, {text} AS whole, regexp_extract_all('{_START}' || translate(lower({text}), '{_START}' || chr(10), ' {_START}'), '{_WORD}') AS words FROM {source}
), {name}_places AS MATERIALIZED (
  SELECT *, list_filter(words, lambda w: NOT list_contains({known}, w)) AS content,
         list_filter(words, lambda w: list_contains({known}, w)) AS anchors,
         list_filter(list_transform(words, lambda w, i: CASE WHEN list_contains({known}, w) THEN i END), lambda i: i IS NOT NULL) AS places
  FROM {name}_words
), {name}_sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(list_transform(
    list_filter(range(1, len(places) + 1), lambda n: places[n] - n + {CHAIN} <= len(content)),
    lambda n: anchors[n] || ' ' || array_to_string(content[places[n] - n + 1 : places[n] - n + {CHAIN}], ' ')))) AS found, whole, words
  FROM {name}_places
), {name} AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(found) > 0 THEN found
    ELSE ['=' || CASE WHEN len(list_filter(words, lambda w: w <> '{_START}')) > 0 THEN array_to_string(words, ' ') ELSE whole END] END AS signs FROM {name}_sets
)"""


_LIKE = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE"

ORACLE = f"""
WITH placed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first(doc_id) OVER (ORDER BY doc_id DESC)) AS next
  FROM documents
), edited AS (
  SELECT p.doc_id, p.text, p.n_chars, p.next,
         substring(p.text, 1, p.n_chars - p.n_chars // 3) || substring(n.text, 1, p.n_chars // 3) AS edited
  FROM placed p JOIN placed n ON n.doc_id = p.next
), {_sets_sql("mine", "edited", "text")}, {_sets_sql("other", "edited", "edited")}
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256,
       sha256(array_to_string(m.signs, chr(10))) AS fingerprint, sha256(array_to_string(o.signs, chr(10))) AS edited_fingerprint,
       {_LIKE.format("m.signs", "o.signs")} AS near_edited, {_LIKE.format("m.signs", "n.signs")} AS near_next,
       len(m.signs) AS n_signatures,
       CAST(floor(ln(len(m.signs)::DOUBLE) / {-math.log(THRESHOLD)!r}::DOUBLE + 1e-9::DOUBLE) AS INTEGER) AS length_partition
FROM edited e JOIN mine m ON m.doc_id = e.doc_id JOIN other o ON o.doc_id = e.doc_id JOIN mine n ON n.doc_id = e.next
"""


@query("op11_spot_sigs", ORACLE)
def spot_sigs(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how like the next document they are."""
    return edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
