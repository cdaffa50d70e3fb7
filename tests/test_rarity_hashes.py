"""Rarity needs the texts once: they are split when their hashes are stored, not when rows are scored."""

from __future__ import annotations

import pytest

from quillsieve.operators import selection as sel


def test_texts_are_not_split_again(spark):
    rows = [("a", 1, "red blue blue"), ("a", 2, "red, green."), ("b", 2, "red"), ("b", 3, ""), ("b", 4, None)]
    scored = sel.rarity_of_rows(spark.createDataFrame(rows, "dataset string, doc_id bigint, text string"))
    assert "split(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.dataset, r.doc_id): r.score for r in scored.collect()}
    assert found == {("a", 1): pytest.approx(1 / 3 + 1 / 2), ("a", 2): pytest.approx(1 / 3 + 1), ("b", 2): pytest.approx(1 / 3)}
