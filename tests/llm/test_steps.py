"""How many written steps an operator takes: each costs a task per shuffle partition, however few its rows are."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from millrace.llm import graph, order_minhash, repair


def counted(monkeypatch):
    labels = []
    for module in (graph, order_minhash):
        def count(df, label, folder=None, write=module.checkpointed):
            labels.append(label)
            return write(df, label, folder)

        monkeypatch.setattr(module, "checkpointed", count)
    return labels


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    links = spark.createDataFrame([(1, 9), (1, 8), (3, 2)], "a bigint, b bigint")
    labels = counted(monkeypatch)
    found = sorted(tuple(r) for r in graph.components(links, "a", "b").collect())
    assert found == [(1, 1), (2, 2), (3, 2), (8, 1), (9, 1)]
    assert labels == ["edges", "low", "large", "edges"]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(20)], "a bigint, b bigint")
    assert {tuple(r) for r in graph.components(links, "a", "b").collect()} == {(n, 0) for n in range(21)}


def test_near_copies_take_few_steps(spark, monkeypatch):
    texts = []
    for base in range(3):
        words = [f"w{base}x{n}" for n in range(60)]
        texts += [" ".join([*words[:n], "new", *words[n + 1 :]]) for n in (0, 20, 59)]
    docs = spark.createDataFrame([*enumerate(texts), (9, "some other text of few words")], "doc_id bigint, text string")
    labels = counted(monkeypatch)
    found = {r["id"]: r["class_id"] for r in order_minhash.classes(docs, threshold=0.7).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 6, 9: 9}
    assert labels.count("links") <= 3  # rounds of alignment


def test_equal_parts_of_texts_are_looked_up_once():
    path, pattern = repair.vocabulary()
    encoder = repair.WordEncoder(path, pattern)
    asked = []

    class Chunks(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    encoder.chunks = Chunks()
    texts = ["alpha beta, beta, Straße", "", "beta, 7 beta, alpha", "a  beta,\n ", "alpha"]
    library = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(found, np.uint32).tolist() for found in encoder.encode(texts)] == [e.ids for e in library]
    assert asked.count("beta,") == 1
    assert encoder.encode(["", ""]) == [b"", b""] and encoder.encode([]) == []


def test_every_rule_unfolds_once(monkeypatch):
    ids = np.tile(np.array([5, 6, 7, 5, 6, 9, 9, 9], np.uint32), 200)
    ends = np.zeros(len(ids), bool)
    ends[249::250] = True
    ends[-1] = True
    rules, symbols, _ = repair.compress(ids, ends, 10)
    many = np.concatenate([symbols, np.full(2 * len(rules), 5, np.uint32)])
    asked = []
    monkeypatch.setattr(repair, "_unfold", lambda s, *a, f=repair._unfold: asked.append(len(s)) or f(s, *a))
    assert len(rules) and (repair.expand(many, rules, 10) == np.concatenate([ids, np.full(2 * len(rules), 5)])).all()
    assert asked == [len(rules)]
    assert (repair.expand(symbols[:1], rules, 10) == ids[: len(repair.expand(symbols[:1], rules, 10))]).all()
    assert repair.expand(symbols[:0], rules, 10).tolist() == [] and repair.expand(ids, rules[:0], 10).tolist() == ids.tolist()


def test_a_word_goes_to_the_model_once_whatever_stands_beside_it():
    path, pattern = repair.vocabulary()
    encoder = repair.WordEncoder(path, pattern)
    texts = ["a stone stone, stone. pebble\npebble", "Straße, Straße. stone; 'stone' it's Straße", "boulder  \n boulder"]
    library = [np.array(e.ids, np.uint32).tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    asked = []

    def tokenize(word, f=encoder.tokenizer.model.tokenize):
        asked.append(word)
        return f(word)

    encoder.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize))
    assert encoder.encode(texts) == library
    assert asked.count("Ġstone") == 1 and len(asked) == len(set(asked))
    assert "stone," not in encoder.chunks  # met once


def test_words_of_the_split():
    path, pattern = repair.vocabulary()
    encoder = repair.WordEncoder(path, pattern)
    pieces = ["", "it's we'll 'tis ''s 's's x'reel 'R", " '  's\n's '", "a \n\t b  ", "　日本 ²Ⅳ1é🙂​\x85\xa0x᠎", "'", "l'l", "'v"]
    alphabet = " \n's　tmdrevlL1²,é日🙂"
    rng = np.random.default_rng(1)
    pieces += ["".join(alphabet[n] for n in rng.integers(0, len(alphabet), size)) for size in range(60)]
    words, edges = encoder._split(pa.array(pieces, pa.large_string()))
    assert [words[a : b].to_pylist() for a, b in zip(edges[:-1], edges[1:])] == [encoder.match(p) for p in pieces]


def test_rare_pairs_hide_no_frequent_one(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.tile([1, 2, 3, 4], 50), rng.permutation(np.arange(10, 20_000))]).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    monkeypatch.setattr(repair, "_BITS", 5)
    rules, symbols, _ = repair.compress(ids, ends, 50_000)
    assert (repair.expand(symbols, rules, 50_000) == ids).all()
    assert rules.tolist() == [[1, 2], [3, 4]] and len(symbols) == len(ids) - 100
