"""Inputs that the given tables lack: equal ids in several datasets, one-sided groups, zero means, empty selections."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillsieve.functions import labels as lb
from quillsieve.functions import text as tx
from quillsieve.operators import dispatch, greedy, overlap, packing, perplexity
from quillsieve.operators import distribution as dist
from quillsieve.operators import selection as sel
from quillsieve.session import pin, scratch, scratch_table
from quillsieve.sources import corpora
from quillsieve.sources import tables as tb
from quillsieve.streaming import jobs

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def two_sets(spark):
    rnd = np.random.default_rng(4)
    rows = [
        (d, i, " ".join(rnd.choice(WORDS[k : k + 12], 8 + i)))
        for k, d in enumerate(("first", "second"))
        for i in range(6)
    ]
    return spark.createDataFrame(rows, "dataset string, doc_id bigint, text string")


@pytest.mark.parametrize("name", sorted({*dispatch.STRATEGIES, *dispatch.ALIASES}))
def test_equal_ids_stay_apart(two_sets, name):
    out = dispatch.prepare_selection(two_sets, name, 3).collect()
    assert len(out) == 3
    texts = {(r.dataset, r.doc_id): r.text for r in two_sets.collect()}
    for r in out:
        shuffled = name in ("shuffled_zipf", "unique_tokens_shuffled")
        assert r.text == texts[r.dataset, r.doc_id] or shuffled and sorted(r.text.split()) == sorted(texts[r.dataset, r.doc_id].split())


@pytest.mark.parametrize("name", ["random_sample", "most_similar", "herding", "zipf", "unique_tokens", "least_perplexity"])
def test_ids_of_any_size_and_rows_without_a_dataset(spark, name):
    ids = [-(2**63), -3, 0, 2**63 - 1]
    rows = [(d, i, f"{d} {i} shared words w{i % 7}") for d in ("first", None) for i in ids]
    docs = spark.createDataFrame(rows, "dataset string, doc_id bigint, text string")
    out = dispatch.prepare_selection(docs, name, 8).collect()
    assert {(r.dataset, r.doc_id, r.text) for r in out} <= {tuple(r) for r in rows}
    assert len(out) == 8
    alone = docs.where("dataset is null")
    found = dispatch.prepare_selection(alone, name, 3).collect()
    assert len(found) == 3 and all(r.dataset is None and r.doc_id in ids for r in found)


def test_rarity_keeps_datasets_apart(two_sets):
    found = sel.select_zipf(two_sets, 100).collect()
    assert len(found) == len({(r.dataset, r.doc_id) for r in found}) == two_sets.count()
    shuffled = sel.select_shuffled_zipf(two_sets, 100).collect()
    texts = {(r.dataset, r.doc_id): sorted(r.text.lower().split()) for r in two_sets.collect()}
    assert {(r.dataset, r.doc_id): sorted(r.text.split()) for r in shuffled} == texts


def test_clusters_do_not_depend_on_partitions(spark):
    rows = [(i, [float(i % 3) * 10 + i / 100, float(i % 3)]) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    one = sorted(sel.cluster_representatives(docs.coalesce(1), 3).collect())
    assert one == sorted(sel.cluster_representatives(docs.repartition(7, "doc_id"), 3).collect())
    assert sorted(r.members for r in one) == [20, 20, 20]
    assert sorted(r.doc_id % 3 for r in one) == [0, 1, 2]
    assert all(27 <= r.doc_id <= 32 for r in one)
    assert len(sel.cluster_representatives(docs.where("doc_id < 2"), 3).collect()) == 2
    assert sel.cluster_representatives(docs.where("doc_id < 0"), 3).count() == 0


def test_sets_read_from_intervals(spark):
    split = spark.createDataFrame(
        [(i, "inside" if i < 4 else "tail", None if i < 4 else i - 3) for i in range(11)], "doc_id bigint, part string, rank bigint"
    )
    held = sel.incremental_intervals(split, split, 3)
    assert held.count() == 4 + 2 * 7
    labelled = {}
    for r in sel.incremental_sets(split, split, 3).collect():
        labelled.setdefault(r.label, set()).add(r.doc_id)
    for label, members in labelled.items():
        series, _, added = label.partition("_add_")
        got = sel.set_members(held, series, int(added)) if added else sel.set_members(held)
        assert {r.doc_id for r in got.collect()} == members
    assert set(labelled) == {"intersection", *[f"{s}_add_{n}" for s in ("tail", "random") for n in (3, 6, 7)]}


def test_words_hook_reaches_generated_rows(two_sets):
    letters = F.filter(F.split("text", ""), lambda c: F.trim(c) != "")
    for name in ("random_words", "words_dataset", "dictionary"):
        rows = dispatch.prepare_selection(two_sets, name, 2, words=letters).collect()
        assert rows and all(len(w) == 1 for r in rows for w in r.text.split() if w != "<pad>")


def test_groups_of_one_sample(spark):
    rows = [("both", 1.0, "a"), ("both", 2.0, "b"), ("one", 1.0, "a"), ("same", 3.0, "a"), ("same", 3.0, "b")]
    values = spark.createDataFrame(rows, "layer string, x double, side string")
    found = {r.layer: r for r in dist.two_sample_distances(values).collect()}
    assert found["both"].wasserstein == 1.0 and found["both"].ks == 1.0
    assert found["one"].wasserstein is None and found["one"].ks is None and found["one"].n_b == 0
    assert found["same"].wasserstein == 0.0 and found["same"].ks == 0.0
    bins = {(r.layer, r.bin): (r.n, r.density) for r in dist.histogram(values, ["layer"], 4).collect()}
    assert bins["same", 0] == (2, None) and bins["one", 0] == (1, None)


def test_zero_mean(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 2.0)], "v double, m double")
    assert [r[0] for r in df.select(lb.coef_variation(F.col("v"), F.col("m"), True)).collect()] == [None, 1.0]


def test_empty_subset_is_infinitely_far(spark):
    full = spark.createDataFrame([("a", 2), ("b", 2)], "token string, n bigint")
    subset = spark.createDataFrame([("some", "a", 1), ("some", "b", 1)], "method string, token string, n bigint")
    groups = spark.createDataFrame([("some",), ("none",)], "method string")
    found = {r.method: r.kl for r in dist.kl_divergence(full, subset, groups=groups).collect()}
    assert found["some"] == pytest.approx(0.0, abs=1e-9) and found["none"] == math.inf


def test_no_picks_and_one_row(spark):
    rows = spark.createDataFrame([("d", i, [float(i), 1.0]) for i in range(4)], "dataset string, doc_id bigint, embedding array<double>")
    assert greedy.select_k_center(rows, 0).count() == 0 and greedy.select_herding(rows, 0).count() == 0
    split = sel.centroid_split(rows, rows.where("doc_id = 1").select("doc_id")).collect()
    assert {r.doc_id for r in split if r.part == "inside"} == {1}


def test_unseen_bigrams_are_smoothed(spark):
    def pairs(rows):
        return perplexity.pair_counts(spark.createDataFrame(rows, "doc_id bigint, words array<string>"))

    model = perplexity.train(pairs([(0, ["a", "b", "a", "b"])]))
    scored = {r.doc_id: r for r in perplexity.mean_nll(pairs([(1, ["a", "b", "c", "d"]), (2, ["x", "y"]), (3, ["z"])]), model).collect()}
    # two words are known; "a b" was seen twice of two times, the others never
    want = (-math.log(3 / 4) - math.log(1 / 3) - math.log(1 / 2)) / 3
    assert scored[1].nll == pytest.approx(want) and scored[1].n == 3
    assert scored[2].nll == pytest.approx(math.log(2)) and set(scored) == {1, 2}


def test_multiset_overlap_equals_the_blocked_one(two_sets):
    docs = two_sets.where("dataset = 'first'").unionByName(two_sets.where("dataset = 'second'").withColumn("doc_id", F.col("doc_id") + 6))
    docs = docs.unionByName(docs.limit(1).select("dataset", F.lit(99).cast("bigint").alias("doc_id"), F.lit("").alias("text")))
    for keys in ((), ("dataset",)):
        sizes = {d: n for d, n in docs.groupBy(*(keys or [F.lit("all")])).count().collect()}
        full = docs.where("text <> ''")  # the blocked form leaves rows without words out
        with_words = {d: n for d, n in full.groupBy(*(keys or [F.lit("all")])).count().collect()}
        blocked = overlap.mean_overlap(overlap.token_multisets(full, keep=keys), overlap.MULTISET_UNION, keys)
        linear = {r.doc_id: r for r in overlap.mean_multiset_overlap(docs, keys=keys).collect()}
        for r in blocked.collect():
            group = r.dataset if keys else "all"
            assert linear[r.doc_id].score == pytest.approx(r.score * with_words[group] / sizes[group], abs=2e-9)
        assert linear[99].score == 0.0


def test_long_document_in_windows(spark):
    words = [f"w{i}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, ["x"]), (2, words), (3, [])], "doc_id bigint, words array<string>")
    found = {r["window"]: r["words"] for r in packing.pack_windows(docs, 100).collect()}
    flat = ["x", *words]
    assert found == {i: flat[i * 100 : (i + 1) * 100] for i in range(500)}
    first = packing.eval_windows(docs, 100, 3).collect()
    assert {r["window"] for r in first} == {0, 1, 2} and packing.eval_windows(docs, 100).count() == 500


def test_growing_sets_take_the_whole_tail(spark):
    rows = spark.range(20).withColumnRenamed("id", "doc_id")
    split = rows.select("doc_id", F.when(F.col("doc_id") < 9, "inside").otherwise("tail").alias("part"))
    split = split.withColumn("rank", F.when(F.col("part") == "tail", F.col("doc_id") - 8))
    sets: dict[str, set] = {}
    for r in sel.incremental_sets(split, rows, 4).collect():
        assert r.doc_id not in sets.setdefault(r.label, set())
        sets[r.label].add(r.doc_id)
    assert {k: len(v) for k, v in sets.items()} == {
        "intersection": 9, "tail_add_4": 13, "tail_add_8": 17, "tail_add_11": 20, "random_add_4": 13, "random_add_8": 17, "random_add_11": 20,
    }


def test_draws_reach_beyond_32_bits(spark):
    drawn = spark.range(200).select(tx.seeded_int(1, 1 << 50, F.col("id")).alias("x")).agg(F.max("x"), F.min("x")).first()
    assert drawn[0] > 1 << 40 and drawn[1] >= 0


def test_splits_by_folder_below_the_root(spark):
    root = scratch_table(spark, "training-data")
    spark.range(5).write.parquet(f"{root}/mine/part-a")
    spark.range(7).write.json(f"{root}/mine/part-b")
    assert corpora.read_corpus(spark, "mine", root, "train").count() == 12  # no path names it: every file is read
    spark.range(3).write.parquet(f"{root}/mine/train")
    assert corpora.read_corpus(spark, "mine", root, "train").count() == 3
    spark.range(1).write.csv(f"{root}/other")
    with pytest.raises(FileNotFoundError):
        corpora.read_corpus(spark, "other", root)


def test_counts_of_a_model_with_a_slash(spark):
    path = scratch_table(spark, "counts")
    for n, model in ((1, "org/a b=c"), (2, "plain"), (3, "org/a b=c")):
        counts = spark.createDataFrame([("x", n)], "token string, n bigint")
        tb.save_token_counts(counts, path, model, "set", "full", 0)
    assert [r["count"] for r in tb.load_token_counts(spark, path, model="org/a b=c").collect()] == [3]
    assert [r["count"] for r in tb.load_token_counts(spark, path, model="plain").collect()] == [2]


def test_stream_of_a_folder_in_batches(spark):
    source = scratch_table(spark, "stream")
    for i in range(3):
        spark.createDataFrame([(f"a b w{i}",), ("a",)], "text string").coalesce(1).write.mode("append").parquet(source)
    table, checkpoint = jobs.job_folders(spark, "counts")
    stream = jobs.read_stream(spark, source, 1).withColumn("doc_id", F.lit(1))
    want = {"a": 6, "b": 3, "w0": 1, "w1": 1, "w2": 1}
    assert {r.token: r.n for r in jobs.stream_word_counts(stream, table, checkpoint).collect()} == want
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 3
    # nothing new: the same state, and no batch counts twice
    assert {r.token: r.n for r in jobs.stream_word_counts(stream, table, checkpoint).collect()} == want


def test_scope_removes_what_was_pinned(spark):
    kept = pin(spark.range(3))
    with scratch(spark):
        inside = pin(spark.range(5))
        files = inside.inputFiles()
        assert files and inside.count() == 5
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        spark.read.parquet(files[0])
    assert kept.count() == 3


def test_growing_sets_are_written_by_as_many_tasks_as_they_need(spark, monkeypatch):
    split = spark.range(300, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "inside").otherwise("tail").alias("part"), F.when(F.col("id") >= 100, F.col("id") - 99).alias("rank")
    )
    want = sorted(sel.incremental_sets(split, split, 5).collect())
    assert len(want) == len(set(want)) == 100 * 81 + 2 * 5 * 40 * 41 // 2
    monkeypatch.setattr(sel, "LABELLED_ROWS", 1000)
    sets = sel.incremental_sets(split, split, 5)
    tasks = [len(part) for part in sets.rdd.glom().collect()]
    assert len(tasks) == 17 and max(tasks) < 2 * len(want) / 17
    assert sorted(sets.collect()) == want
