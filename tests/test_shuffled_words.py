"""The random order of a row's words is made by tasks from whole arrays, not by an expression for each word."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.plans import all_queries  # noqa: F401 - importing registers the queries
from quillsieve.plans.registry import QUERIES


def test_order_is_that_of_the_keys(spark):
    texts = ["b a b. c", None, "", "one", " ".join(f"w{i % 7}" for i in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = docs.select("doc_id", tx.shuffle_words(tx.zipf_words(F.col("text")), F.col("doc_id"), 7).alias("words")).collect()

    def want(doc_id, text):
        if text is None:
            return None
        words = text.replace(".", " ").split()
        parts = ["7"] + ([] if doc_id is None else [str(doc_id)])
        keys = [hashlib.md5(":".join([*parts, str(i)]).encode()).hexdigest() for i in range(len(words))]
        return [words[i] for i in sorted(range(len(words)), key=lambda i: (keys[i], i))]

    assert {r.doc_id: r.words for r in found} == {i: want(i, t) for i, t in rows}


def test_no_key_is_made_by_an_expression_for_each_word(spark, sf_dir):
    plan = QUERIES["shuffle_words"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
