"""Selections against plain numpy versions, and the properties every selection has."""

import collections

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsieve.functions import text as tx
from quillsieve.operators import counts as ct
from quillsieve.operators import dispatch
from quillsieve.operators import distribution as dist
from quillsieve.operators import generation as gen
from quillsieve.operators import greedy, packing
from quillsieve.operators import selection as sel
from quillsieve.plans.tables import documents, vectors


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    rows = vectors(spark, sf_dir).cache()
    table = {}
    for r in rows.orderBy("doc_id").collect():
        table.setdefault(r["dataset"], []).append((r["doc_id"], np.array(r["embedding"])))
    return rows, table


def picks(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("rank").collect():
        out[r["dataset"]].append(r["doc_id"])
    return out


@pytest.mark.parametrize("pool", [3, 512])
def test_k_center(points, pool):
    rows, table = points
    got = picks(greedy.select_k_center(rows, 12, pool))
    for dataset, items in table.items():
        ids, x = [i for i, _ in items], np.stack([v for _, v in items])
        chosen = [0]
        while len(chosen) < 12:
            least = np.round(np.min([((x - x[c]) ** 2).sum(axis=1) for c in chosen], axis=0), 9)
            least[chosen] = -1
            chosen.append(int(np.argmax(least)))
        assert got[dataset] == [ids[c] for c in chosen]


@pytest.mark.parametrize("pool", [4, 512])
def test_herding(points, pool):
    rows, table = points
    got = picks(greedy.select_herding(rows, 12, pool))
    for dataset, items in table.items():
        ids, x = [i for i, _ in items], np.stack([v / np.linalg.norm(v) for _, v in items])
        mean, total, chosen = x.mean(axis=0), np.zeros(x.shape[1]), []
        for t in range(1, 13):
            value = np.round(x @ (t * mean - total), 9)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            total = total + x[chosen[-1]]
        assert got[dataset] == [ids[c] for c in chosen]


@pytest.mark.parametrize("pool", [2, 128])
def test_coverage(spark, sf_dir, pool):
    docs = documents(spark, sf_dir)
    got = picks(greedy.select_unique_tokens(docs, 6, pool=pool))
    sets = collections.defaultdict(dict)
    for r in docs.select("dataset", "doc_id", tx.zipf_words(F.col("text")).alias("w")).collect():
        sets[r["dataset"]][r["doc_id"]] = set(r["w"])
    for dataset, rows in sets.items():
        covered, chosen = set(), []
        while len(chosen) < min(6, len(rows)):
            best = max((i for i in rows if i not in chosen), key=lambda i: (len(rows[i] - covered), len(rows[i]), -i))
            chosen.append(best)
            covered |= rows[best]
        assert got[dataset] == chosen


def test_decoupled_with_small_pools(spark):
    texts = ["a b c d e", "a b c d f", "g h i j k", "a b c d e", "g h i j l m n o p", "q r"]
    data = [("all", i, t, 1.0 - i / 10) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(data, "dataset string, doc_id bigint, text string, score double")
    for pool in (1, 2, 128):
        assert picks(greedy.select_decoupled(rows, 10, 0.4, pool=pool))["all"] == [0, 2, 4, 5]


def test_dispatch_sizes(spark, sf_dir):
    docs = documents(spark, sf_dir).where("dataset in ('src1', 'src2', 'src3')").select("dataset", "doc_id", "text").cache()
    for name in ("random", "zipf", "most_similar", "herding", "shuffled_zipf", "distribution_matching_no_outliers"):
        rows = dispatch.prepare_selection(docs, name, 5).collect()
        assert len(rows) == 5 and len({r["doc_id"] for r in rows}) == 5
    assert dispatch.prepare_selection(docs, "concat").count() == docs.count()
    with pytest.raises(ValueError):
        dispatch.prepare_selection(docs, "no such name")


def test_selections_do_not_depend_on_partitions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for select in (lambda d: sel.select_random(d, 3), lambda d: sel.select_zipf(d, 20), lambda d: gen.gen_bag_of_words(d, 4, 16)):
        assert sorted(select(docs).collect()) == sorted(select(docs.repartition(13, "text")).collect())


def test_shuffle_keeps_the_words(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = ct.word_counts(ct.token_rows(docs))
    after = ct.word_counts(ct.token_rows(docs, tx.shuffle_words(tx.zipf_words(F.col("text")), F.col("doc_id"))))
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0


def test_kl_of_a_counter_with_itself(spark, sf_dir):
    counts = ct.word_counts(ct.token_rows(documents(spark, sf_dir)))
    kl = dist.kl_divergence(counts, counts.withColumn("method", F.lit("same"))).first()["kl"]
    assert abs(kl) < 1e-5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.lists(st.integers(0, 9), min_size=1, max_size=30))
def test_two_sample_distances(spark, a, b):
    data = [(0, float(x), "a") for x in a] + [(0, float(x), "b") for x in b]
    rows = spark.createDataFrame(data, "layer int, x double, side string")
    got = dist.two_sample_distances(rows).first()
    grid = np.arange(-1, 11)
    gap = np.abs(np.array([np.mean(np.array(a) <= g) - np.mean(np.array(b) <= g) for g in grid]))
    assert got["wasserstein"] == pytest.approx(gap.sum(), abs=1e-9)
    assert got["ks"] == pytest.approx(gap.max(), abs=1e-9)


def test_windows_use_every_word_once(spark):
    rows = spark.createDataFrame([(i, [f"w{i}_{j}" for j in range(i % 9)]) for i in range(60)], "doc_id bigint, words array<string>")
    flat = [w for r in rows.orderBy("doc_id").collect() for w in r["words"]]
    packed = packing.pack_windows(rows, 16).orderBy("window").collect()
    assert [w for r in packed for w in r["words"]] == flat[: len(flat) // 16 * 16]
    short = packing.pack_windows(rows, 10_000).collect()
    assert len(short) == 1 and short[0]["words"] == flat
