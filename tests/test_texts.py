from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import words
from millrace.plans.training import tokenize

TEXTS = ["One two\tTHREE", "", None, " \n ", "  lead word ", "a\u00a0b", " ".join(f"W{i}" for i in range(300)),
         " " + " ".join(f"w{i}" for i in range(258)), " ".join(f"w{i}" for i in range(256)) + "\n"]


def test_texts_without_words_have_no_first_and_last_word(spark, tmp_path):
    rows = [(i, text) for i, text in enumerate(TEXTS)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.first_word, r.last_word) for r in tokenize(spark, str(tmp_path)).collect()}
    assert got == {
        0: (3, "one", "three"), 1: (0, None, None), 2: (None, None, None), 3: (0, None, None),
        4: (2, "lead", "word"), 5: (2, "a", "b"), 6: (256, "w0", "w255"), 7: (256, "w0", "w255"),
        8: (256, "w0", "w255"),
    }


@pytest.mark.parametrize("most", [0, 1, 2, 3, 256, (1 << 31) - 1])
def test_words_are_those_of_the_whole_text(spark, most):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for row in texts.select("text", words(F.col("text"), most).alias("w")).collect():
        assert row.w == (None if row.text is None else row.text.lower().split()[:most])
