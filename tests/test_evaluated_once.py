"""Texts are split into words once for each row, however often the words are used."""

from __future__ import annotations

import pytest

from quillsieve.functions import text as tx
from quillsieve.plans import all_queries  # noqa: F401 - importing registers the queries
from quillsieve.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["ngrams", "shuffle_words"])
def test_one_split_a_row(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_blanks_are_the_class_of_the_sql(spark):
    chars = spark.range(65536).where("id < 55296 or id > 57343")
    chars = chars.selectExpr("concat('a', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE'), 'b') as text")
    split = chars.select(tx.plain_words(chars.text).alias("words"), tx.F.split(tx.F.lower("text"), tx.WHITESPACE).alias("want"))
    assert split.where("array_remove(want, '') != words").isEmpty()
    assert split.where("size(words) = 2").count() == 29
