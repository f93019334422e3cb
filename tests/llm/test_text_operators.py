"""Language, toxicity, near copies, curriculum and BPE against brute force, with odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import MIDDLE, SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from millrace.llm import curriculum, language_id, order_minhash, prefix_bpe, toxicity
from millrace.llm.pieces import chunks

LONG = "a long text of many words that goes on and on " * 3000
ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size string"
ROWS = [
    (1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, None, None), (3, " \n\t", "en", "s", 3, None, None),
    (4, "one", "en", "s", 3, "k", "z"), (5, LONG, "en", "s", len(LONG), "k", "z"), (5, LONG, "en", "s", len(LONG), "k", "z"),
    (6, LONG, "en", None, len(LONG), None, None), (None, "no id here", "de", "t", 10, None, None),
    (7, "Größe und straße 日本語 🎉\u0000 x", "de", "t", 5, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet")


# -- BPE -------------------------------------------------------------------------------------

ENCODER = prefix_bpe.PrefixEncoder.load(*prefix_bpe.vocabulary())
EXACT = tiktoken.Encoding(
    "own", pat_str=prefix_bpe.vocabulary()[1], mergeable_ranks=ENCODER.ranks, special_tokens={}
)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeionrst  \n\t's'll.,!?éßñ12 日🎉\x1c\x85᠎ABCthe")), max_size=40))
def test_chunks_and_ids_are_those_of_the_whole_text(text):
    assert [m for c in chunks(text) for m in ENCODER.match(c)] == ENCODER.match(text)
    assert ENCODER.encode(text) == EXACT.encode_ordinary(text)
    assert ENCODER.decode(np.array(ENCODER.encode(text), np.int64)) == text.encode()


def test_edits_keep_the_encoding_exact():
    rng, letters = random.Random(3), "aeionrst  \n's.!é1"
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        edited = prefix_bpe.EditedText(ENCODER, text)
        for _ in range(8):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 5))
            new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            text = text[:a] + new + text[b:]
            edited.replace(a, b, new)
            assert edited.text == text and edited.ids == EXACT.encode_ordinary(text)


def test_encode_and_decode_odd_rows(spark, odd, none):
    found = prefix_bpe.decode_ids(prefix_bpe.encode_texts(odd)).collect()
    assert len(found) == len(ROWS)
    for row in found:
        assert bytes(row.decoded) == (row.text or "").encode() and row.ids == EXACT.encode_ordinary(row.text or "")
    assert prefix_bpe.decode_ids(prefix_bpe.encode_texts(none), digests=True).count() == 0


# -- curriculum ------------------------------------------------------------------------------


def test_mix_meets_targets(spark, docs):
    sized = docs.select("doc_id", "source", curriculum.word_count("text").alias("size"))
    rows = curriculum.mix(sized).collect()
    taken, target, total = collections.Counter(), {}, 0
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        total += r.size
        assert 0 <= r.taken <= 3 * r.size and all(0 <= p <= 1 for p in r.positions)
        assert r.target <= 3 * r.source_size + 1e-6 and len(r.positions) in (r.taken // max(r.size, 1), r.taken // max(r.size, 1) + 1)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - total) < 1e-3
    firsts = [r.positions[0] for r in rows if r.positions]
    assert firsts == sorted(firsts)


@pytest.mark.parametrize("curve", curriculum.SCHEDULES)
def test_inverse_undoes_the_integral(spark, curve):
    from pyspark.sql import functions as F

    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    step = 1 / (len(curve) - 1)
    whole = sum((a + b) / 2 * step for a, b in zip(curve, curve[1:]))
    for s, t in shares.select("s", curriculum.inverse(F.col("s"), curve)).collect():
        xs = np.linspace(0, t, 2001)
        area = np.trapezoid(np.interp(xs, np.linspace(0, 1, len(curve)), curve), xs)
        assert abs(area / whole - s) < 1e-5


def test_mix_odd_rows(odd, none):
    sized = odd.withColumn("words", curriculum.word_count("text"))
    rows = curriculum.mix(sized, size_column="words").collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken == 0 and r.positions == [] for r in rows if r.words == 0)
    assert curriculum.mix(none.withColumn("words", curriculum.word_count("text")), size_column="words").count() == 0


# -- near copies -----------------------------------------------------------------------------


def _labelled(text):
    words, seen, out = text.lower().split(), collections.Counter(), set()
    for i in range(max(1, len(words) - 4)):
        run = tuple(words[i : i + 5])
        out.add((run, seen[run]))
        seen[run] += 1
    return out


def test_every_near_pair_shares_a_class(docs):
    rows = docs.select("doc_id", "text").collect()
    of = {r.id: r.class_id for r in order_minhash.classes(docs).collect()}
    runs = [_labelled(r.text) for r in rows]
    where = collections.defaultdict(list)
    for i, own in enumerate(runs):
        for run in own:
            where[run].append(i)
    met = {(a, b) for v in where.values() for n, a in enumerate(v) for b in v[n + 1 :]}
    near = [(a, b) for a, b in met if len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= 0.8]
    assert near and all(of[rows[a].doc_id] == of[rows[b].doc_id] for a, b in near)
    # A class needs a near pair: singles stay single.
    linked = {i for pair in near for i in pair}
    sizes = collections.Counter(of.values())
    assert all(sizes[of[r.doc_id]] == 1 for i, r in enumerate(rows) if i not in linked)


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = rng.permutation(40)[:30].astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 4)):
            i, j = rng.integers(0, 30, 2)
            b[i], b[j] = b[j], b[i]
        table = np.zeros((31, 31), int)
        for i in range(30):
            for j in range(30):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        exact = table[30, 30] / (60 - table[30, 30])
        found = order_minhash.aligned(a, b, 0.6)
        assert found == pytest.approx(exact) if exact >= 0.6 else found < 0.6 or found >= exact


def test_order_matters():
    a = np.arange(100, dtype=np.uint64)
    assert order_minhash.aligned(a, np.roll(a, 50), 0.8) < 0.8


def _words(rng, n):
    return [f"w{v}" for v in rng.integers(0, 10**9, n)]


def _classes_of(spark, texts):
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.id: r.class_id for r in order_minhash.classes(frame).collect()}


def _similar(a, b):
    a, b = (np.concatenate([r for _, r, _ in order_minhash._runs(pa.array([t]), 5)]) for t in (a, b))
    return order_minhash.aligned(a, b, 0.5)


@pytest.mark.parametrize("pairs", [20, 150])
def test_pairs_of_a_family_with_a_passage(spark, pairs):
    # Each pair is near; across pairs only the passage is shared.
    rng = np.random.default_rng(3)
    passage, texts = _words(rng, 170), []
    for _ in range(pairs):
        own = _words(rng, 30)
        texts += [" ".join(passage + own), " ".join(passage + own[:14] + _words(rng, 16))]
    assert min(_similar(a, b) for a, b in zip(texts[::2], texts[1::2])) >= 0.8 > _similar(texts[0], texts[2])
    of = _classes_of(spark, texts)
    assert of == {n: n - n % 2 for n in range(2 * pairs)}


def test_a_text_near_one_linked_copy_only(spark):
    # Its only neighbour meets a smaller copy in every bucket and is linked there.
    rng = np.random.default_rng(4)
    base = _words(rng, 200)
    changed = base[:20] + _words(rng, 4) + base[24:]
    texts = []
    for start in [base] * 60 + [changed] * 60:
        copy = list(start)
        copy[int(rng.integers(80, 190))] = _words(rng, 1)[0]
        texts.append(" ".join(copy))

    def last(words):
        # Blanks change the key only; the largest key of all is the smallest of no bucket.
        text = " ".join(words)
        while hashlib.md5(text.encode()).hexdigest() < "fd":
            text += " "
        return text

    texts = [t for t in texts if hashlib.md5(t.encode()).hexdigest() < "fd"]
    linked, alone = last(changed), last(changed[:45] + _words(rng, 14) + changed[59:])
    near = [n for n, t in enumerate([*texts, linked]) if _similar(t, alone) >= 0.8]
    assert near == [len(texts)] and _similar(texts[0], linked) >= 0.8
    of = _classes_of(spark, [*texts, linked, alone])
    assert set(of.values()) == {0}


def test_near_copies_odd_rows(odd, none):
    found = {(r.id, r.class_id) for r in order_minhash.classes(odd).collect()}
    assert {(5, 5), (6, 5), (2, 2), (3, 3), (1, 1), (None, None)} <= found
    kept = order_minhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7]
    assert order_minhash.classes(none).count() == 0 and order_minhash.deduplicate(none).count() == 0


# -- toxicity --------------------------------------------------------------------------------


def test_held_out_accuracy_and_hidden_labels(spark):
    rng = random.Random(1)
    bad = ["scumbag", "vermin", "garbage", "worthless"]
    words = ["w%d" % i for i in range(3000)]
    rows, labels = [], []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, truth)
    held = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [(s >= 0.5) == (i % 4 == 0) for i, s in held.items()]
    assert len(right) > 400 and np.mean(right) > 0.97
    # Labels of the held-out fold change nothing.
    from pyspark.sql import functions as F

    wrong = truth.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.learn(docs, wrong)
    assert np.array_equal(model.tables[0], other.tables[0]) and np.array_equal(model.thresholds, other.thresholds)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for truth in (labels, labels.limit(0)):
        model = toxicity.learn(odd, truth)
        rows = toxicity.score_texts(odd, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.toxicity <= 1 for r in rows)
        assert len({r.toxicity for r in rows if not (r.text or "").strip()}) == 1
        assert toxicity.score_texts(none, model).count() == 0


def test_scores_are_those_of_a_plain_convolution():
    texts = ["the bad word", "all fine here and there", ""]
    model = toxicity.fit(texts * 5, np.array([1, 0, 0] * 5), np.zeros(15, bool), 0.3, bits=8, epochs=1)
    for text in texts:
        (_, _, data, offsets), = toxicity.blocks(toxicity.pa.array([text]))
        words, first = toxicity.word_hashes(data, offsets)
        one, two, _ = toxicity.buckets(words, first, 8)
        x = [np.concatenate([model.tables[0][a], model.tables[1][b]]) for a, b in zip(one, two)]
        pooled = []
        for w in toxicity.WIDTHS:
            starts = range(max(1, len(words)))
            outs = [sum(x[i + j] @ model.filters[w][j] for j in range(w)) + model.biases[w] for i in starts]
            pooled.append(np.maximum(np.max(outs, axis=0), 0))
        plain = float(np.concatenate(pooled) @ model.weights + model.offset)
        assert toxicity.logits(model, words, first)[0] == pytest.approx(plain, abs=1e-4)
    # Neighbours in a block change nothing.
    (_, _, data, offsets), = toxicity.blocks(toxicity.pa.array(texts))
    together = toxicity.logits(model, *toxicity.word_hashes(data, offsets))
    alone = [toxicity.logits(model, *toxicity.word_hashes(d, o))[0] for t in texts for _, _, d, o in toxicity.blocks(toxicity.pa.array([t]))]
    assert together == pytest.approx(alone, abs=1e-5)


# -- language --------------------------------------------------------------------------------


def test_languages_of_documents(docs):
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, "text", None, "source").collect()
    assert len(found) == docs.count() and np.mean([r.language == r.lang for r in found]) > 0.99


def test_fusion_is_bayes(spark):
    """Posterior from counted evidence, next to the same sums written out."""
    rows = [
        ("the cat and the dog", "en", "a.x.com"), ("the end of the day", "en", "a.x.com"), ("der hund und die katze", "de", "b.x.de"),
        ("das ende und der tag", "de", "b.x.de"), ("zz", "en", "a.x.com"), ("qq", None, None),
    ]
    frame = spark.createDataFrame(rows, "text string, said string, host string")
    model = language_id.fit([r[0] for r in rows[:4]], ["en", "en", "de", "de"])
    got = {r.text: r for r in language_id.identify(frame, model, "text", "said", "host").collect()}
    names = [*model.languages, "und"]
    ll = {}
    for text, _, _ in rows:
        (_, _, data, offsets), = language_id.blocks(language_id.pa.array([text]))
        ll[text] = language_id.evidence(model, data, offsets, 40)[0]
    p = {t: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for t, v in ll.items()}
    total = sum(p.values())
    overall = (total + 1) / (total.sum() + len(names))

    def share(values, own):
        table = {v: sum(p[t] for t, _, _ in rows if values[t] == v) for v in set(values.values()) if v}
        return np.log((table[own] + 0.5) / (total + 0.5 * (len(table) + 1))) if own else 0

    said = {t: s for t, s, _ in rows}
    host = {t: h for t, _, h in rows}
    suffix = {t: h and h.rsplit(".", 1)[1] for t, _, h in rows}
    domain = {t: h and ".".join(h.split(".")[-2:]) for t, _, h in rows}
    for text, _, h in rows:
        if h:
            d = sum(p[t] for t in domain if domain[t] == domain[text])
            d = (d + 5 * overall) / (d.sum() + 5)
            prior = np.log(np.maximum(sum(p[t] for t in host if host[t] == h) + 5 * d - p[text], 1e-9))
        else:
            prior = np.log(overall)
        joint = ll[text] + prior + share(said, said[text]) + share(suffix, suffix[text])
        mass = np.exp(joint - joint.max())
        assert got[text].language == names[int(joint.argmax())]
        assert got[text].confidence == pytest.approx(1 / mass.sum(), rel=1e-6)


def test_language_odd_rows(spark, odd, none):
    for model in (language_id.learn(odd), language_id.learn(none)):
        assert language_id.identify(odd, model, "text", "lang", "source").count() == len(ROWS)
        assert language_id.identify(none, model, "text", "lang", "source").count() == 0


def test_page_parts(spark):
    html = '<!DOCTYPE html><HTML class="x" lang="de-AT"><script>var a="<p>no</p>";</script><!-- no --><p>ja &amp; ja</p>'
    frame = spark.createDataFrame([(html, "https://u@Www.Example.DE:80/a?b"), (None, None), ("", "nonsense")], "h string, u string")
    rows = frame.select(
        language_id.declared_language("h").alias("d"), language_id.host_of("u").alias("o"), language_id.visible("h").alias("v")
    ).collect()
    assert (rows[0].d, rows[0].o, rows[0].v.split()) == ("de", "www.example.de", ["ja", "ja"])
    assert rows[1] == (None, None, None) and rows[2][:2] == (None, None)


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        found = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert found.columns == columns
        if n == 0:
            assert found.count() == docs.count()
        if n == 2:
            before = {r.id: r.class_id for r in order_minhash.classes(docs).collect()}
            assert sorted(r.doc_id for r in found.collect()) == sorted(set(before.values()))
        docs = found
    for row in docs.limit(50).collect():
        assert row.n_tokens == len(row.ids)
