"""Strategies of one corpus split its texts once where they only compare words, and give the same rows as alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import dispatch, generation, perplexity

NAMES = ("dictionary", "least_perplexity", "prototype_iou", "tail_then_match", "unique_tokens", "zipf")


@pytest.mark.parametrize("sets", [1, 2])
def test_texts_are_split_once(spark, sets):
    texts = [f"w{i % 7} x{i % 5} y{i} common w{i % 3}" for i in range(40)] + ["", None]
    docs = spark.createDataFrame([(f"set{i % sets}", i, t) for i, t in enumerate(texts)], "dataset string, doc_id bigint, text string")
    split = spark.sparkContext.accumulator(0)

    def counted(text):
        split.add(1)
        return None if text is None else text.split()

    vectors = docs.select("dataset", "doc_id", F.array(F.col("doc_id") + 1.0, F.lit(1.0)).alias("embedding"))
    words = F.udf(counted, "array<string>")(F.col("text"))
    found = {n: rows.drop("text").collect() for n, rows in dispatch.prepare_selections(docs, NAMES, 3, vectors, words).items()}
    # hashes in order, and counts of the words themselves; Spark may evaluate a column twice
    assert split.value <= 4 * len(texts)
    for name in ("least_perplexity", "zipf"):
        assert sorted(found[name]) == sorted(dispatch.prepare_selection(docs, name, 3, vectors).drop("text").collect())


def test_counts_of_bigrams_where_they_meet(spark, monkeypatch):
    """Many tasks or one, frequent bigrams apart or not."""
    texts = [(i, None if i == 4 else f"a b c{i % 3} d{i} a b".split()) for i in range(30)]
    rows = spark.createDataFrame([*texts, (7, ["a", "b", "z"])], "doc_id bigint, words array<string>")

    def scores() -> dict:
        pairs = perplexity.pair_counts(rows)
        return {r.doc_id: r.score for r in perplexity.ngram_perplexity(pairs, perplexity.train(pairs)).collect()}

    want = scores()
    monkeypatch.setattr(perplexity, "HOT_SHARE", 1)
    monkeypatch.setattr(perplexity, "COUNTED_ROWS", 5)
    assert scores() == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("letters", [1, 1000])
def test_any_guess_of_the_number_of_words_gives_the_same_bag(spark, monkeypatch, letters):
    texts = [(i, " ".join(f"{'long' * 8}{k}" for k in range(i % 40))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = {n: sorted(generation.gen_bag_of_words(docs, n, 16).collect()) for n in (2, 200)}
    monkeypatch.setattr(generation, "LETTERS", letters)
    assert {n: sorted(generation.gen_bag_of_words(docs, n, 16).collect()) for n in (2, 200)} == want
    assert [len(rows) for rows in want.values()] == [2, 200]
