"""Texts are split once; counts, scores and overlaps come from the bags that this leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

from quillsieve.operators import counts as ct
from quillsieve.plans import all_queries  # noqa: F401 - importing registers the queries
from quillsieve.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["kl_divergence", "select_iou_multiset"])
def test_no_word_occurrence_is_a_row_of_its_own(spark, sf_dir, monkeypatch, name):
    made, bags = [], ct.word_bags

    def refused(*args, **kwargs) -> DataFrame:
        raise AssertionError("texts are split into a row a word")

    monkeypatch.setattr(ct, "token_rows", refused)
    monkeypatch.setattr(ct, "word_bags", lambda *a, **k: made.append(1) or bags(*a, **k))
    assert not QUERIES[name](spark, sf_dir).isEmpty()
    assert len(made) == 1
