"""Rows scored by the model of themselves: bigrams are kept and shuffled as hashes, and the scores are those of the unseen path."""

from __future__ import annotations

import numpy as np
import pytest

from quillsieve.operators import perplexity


def test_own_rows_as_unseen_ones(spark):
    rnd = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, [str(w) for w in rnd.choice(vocabulary, rnd.integers(0, 60), p=None)]) for i in range(200)]
    rows += [(200, ["the", "the", "the", "the"]), (201, ["alone"]), (202, []), (203, None), (204, ["the", "w1", "the", "w1"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, words array<string>")
    pairs = perplexity.pair_counts(docs)
    assert dict(pairs.dtypes)["a"] == dict(pairs.dtypes)["b"] == "bigint"
    model = perplexity.train(pairs)
    own = {r.doc_id: r for r in perplexity.mean_nll(pairs, model).collect()}
    other = {r.doc_id: r for r in perplexity.mean_nll(perplexity.pair_counts(docs), model).collect()}
    assert set(own) == set(other) and {201, 202, 203}.isdisjoint(own)
    for i, row in own.items():
        assert row.n == other[i].n and row.nll == pytest.approx(other[i].nll, abs=1e-12)
