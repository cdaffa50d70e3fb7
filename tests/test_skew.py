"""Hot keys: one dataset, word, group of copies or value that holds a third of all rows or more."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.operators import counts as ct
from quillsieve.operators import distribution as dist
from quillsieve.operators import ordering, overlap
from quillsieve.operators import selection as sel
from quillsieve.operators import skew


@pytest.fixture(scope="module")
def hot(spark):
    """3000 rows, half of them in one dataset and a third of them copies of one text."""
    rows = spark.range(3000).withColumnRenamed("id", "doc_id")
    dataset = F.when(F.col("doc_id") % 2 == 0, "big").otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")))
    own = F.concat(F.lit("the word"), F.col("doc_id").cast("string"), F.lit(" of x"), (F.col("doc_id") % 50).cast("string"))
    text = F.when(F.col("doc_id") % 3 == 0, "the same text of all").otherwise(own)
    return rows.select("doc_id", dataset.alias("dataset"), text.alias("text")).repartition(8)


def test_top_n_both_ways_agree(hot, spark):
    order = [F.col("text"), F.col("doc_id")]
    plain = ordering.top_n(hot, order, 20, ["dataset"]).collect()
    limit = spark.conf.get(ordering.GROUP_LIMIT)
    spark.conf.set(ordering.GROUP_LIMIT, "10")
    try:
        salted = ordering.top_n(hot, order, 20, ["dataset"]).collect()
    finally:
        spark.conf.set(ordering.GROUP_LIMIT, limit)
    assert sorted(plain) == sorted(salted)


def test_top_n_limits_before_the_shuffle(hot):
    ranked = ordering.top_n(hot, [F.col("doc_id")], 5, ["dataset"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_global_index_counts_up_in_every_group(hot):
    rows = ordering.global_index(hot, [F.col("text"), F.col("doc_id")], ["dataset"], "place", 1).toPandas()
    for _, group in rows.groupby("dataset"):
        group = group.sort_values(["text", "doc_id"])
        assert group["place"].tolist() == list(range(1, len(group) + 1))


def test_running_totals_with_ties_across_partitions(hot):
    rows = hot.select("dataset", "doc_id", (F.col("doc_id") % 3).alias("v"))
    out = ordering.running_totals(rows, [F.col("doc_id")], ["v"], ["dataset"], ahead="doc_id").toPandas()
    for _, group in out.groupby("dataset"):
        group = group.sort_values("doc_id")
        assert group["cum_v"].tolist() == group["v"].cumsum().tolist()
        assert group["next_doc_id"].dropna().astype(int).tolist() == group["doc_id"].tolist()[1:]


def test_join_counts_equals_a_plain_join(hot):
    pairs = ct.token_rows(hot, distinct=True)
    counts = ct.word_counts(ct.token_rows(hot, keep=())).persist()
    split = skew.join_counts(pairs, counts, ["token"], share=4).select("doc_id", "token", "n")
    plain = pairs.join(counts, "token").select("doc_id", "token", "n")
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_join_checked_beyond_its_limit(hot):
    sizes = hot.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    broadcast = skew.join_checked(hot, sizes, ["dataset"])
    salted = skew.join_checked(hot, sizes, ["dataset"], max_rows=1).select(*broadcast.columns)
    assert broadcast.exceptAll(salted).count() == 0 and salted.count() == 3000
    left = skew.join_checked(hot, sizes.where("dataset = 'big'"), ["dataset"], "left", max_rows=0)
    assert left.count() == 3000 and left.where("n is null").count() == 1500


def test_copies_do_not_multiply_the_pairs(hot):
    pairs = overlap.similar_ngram_pairs(overlap.ngram_sets(hot), 0.9)
    assert pairs.count() == 0
    own = overlap.ngram_sets(hot.where("doc_id < 300"))
    found = {(r["id_a"], r["id_b"]) for r in overlap.similar_ngram_pairs(own, 0.01).collect()}
    sets = {r["doc_id"]: set(r["items"]) for r in own.collect()}
    first = {}
    for doc_id in sorted(sets):
        first.setdefault(frozenset(sets[doc_id]), doc_id)
    reps = sorted(first.values())
    want = {
        (a, b)
        for i, a in enumerate(reps)
        for b in reps[i + 1 :]
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.01
    }
    assert found == want


def test_pairs_split_over_blocks_agree(hot, monkeypatch):
    sets = overlap.ngram_sets(hot.where("doc_id < 400"), 1)
    whole = overlap.similar_ngram_pairs(sets, 0.3).collect()
    monkeypatch.setattr(overlap, "HOT_GROUP", 8)
    assert sorted(whole) == sorted(overlap.similar_ngram_pairs(sets, 0.3).collect())
    assert whole


@pytest.mark.parametrize("union", [None, 64.0])
def test_mean_overlap_against_brute_force(hot, union, monkeypatch):
    docs = hot.where("doc_id < 240")
    make = overlap.token_sets if union is None else overlap.token_multisets
    sets = {r["doc_id"]: (r["dataset"], set(r["items"])) for r in make(docs, keep=["dataset"]).collect()}
    monkeypatch.setattr("quillsieve.operators.blocks.BLOCK_ROWS", 16)
    got = {r["doc_id"]: r["score"] for r in overlap.mean_overlap(make(docs, keep=["dataset"]), union, ["dataset"]).collect()}
    for doc_id, (dataset, items) in sets.items():
        others = [s for i, (d, s) in sets.items() if d == dataset]
        total = sum(len(items & s) / (union or len(items | s)) for s in others) - len(items) / (union or len(items))
        assert got[doc_id] == pytest.approx(total / len(others), abs=1e-8)
    assert len(got) == len(sets)


def test_percentile_of_a_hot_group(hot):
    rows = hot.select("dataset", (F.col("doc_id") % 11).cast("double").alias("x"))
    got = {r["dataset"]: r["m"] for r in ordering.group_percentile(rows, ["dataset"], "x", 0.95, "m").collect()}
    for dataset, group in rows.toPandas().groupby("dataset"):
        assert got[dataset] == pytest.approx(np.percentile(group["x"], 95))


def test_nearest_neighbor_in_pieces(spark):
    rng = np.random.default_rng(1)
    data = [("all", i, rng.normal(size=8).tolist()) for i in range(200)]
    rows = spark.createDataFrame(data, "dataset string, doc_id bigint, embedding array<double>")
    sample = rows.where("doc_id < 30")
    one = {r["doc_id"]: r["distance"] for r in dist.nearest_neighbor(rows, sample).collect()}
    many = {r["doc_id"]: r["distance"] for r in dist.nearest_neighbor(rows, sample, cells=64).collect()}
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], abs=1e-12) for i in one)


def test_selection_of_more_rows_than_there_are(hot):
    assert sel.select_random(hot, 10_000).count() == 3000
    assert sel.select_zipf(hot, 10_000).count() == 3000
