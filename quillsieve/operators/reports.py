"""Reports that select by several methods and measure each selection."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import vectors as vx
from quillsieve.operators import distribution as dist
from quillsieve.operators import selection as sel
from quillsieve.session import pin

VECTOR_METHODS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "random_sample": lambda rows, n: sel.select_random(rows, n),
    "prototype": lambda rows, n: sel.select_most_similar(rows, n),
    "most_different": lambda rows, n: sel.select_most_different(rows, n),
    "distribution_matching": lambda rows, n: sel.select_distribution_matching(rows, n),
}


def _chosen(rows: DataFrame, n: int, methods: Sequence[str]) -> DataFrame:
    parts = [
        VECTOR_METHODS[m](rows, n).select("dataset", "doc_id").withColumn("method", F.lit(m)) for m in methods
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return pin(whole)


def selection_report(rows: DataFrame, n: int, methods: Sequence[str] = tuple(VECTOR_METHODS)) -> DataFrame:
    """Per dataset and method: distance of the score distributions, coverage and centroid distance."""
    picked = sel.join_checked(rows.select("dataset", "doc_id", "embedding"), _chosen(rows, n, methods), ["dataset", "doc_id"])
    picked = pin(picked)
    scores = pin(sel.mean_similarity(rows).select("dataset", "doc_id", "score"))
    # One pass measures all methods: each (dataset, method) is a dataset of its own.
    label = F.concat_ws("|", "dataset", "method")
    names = F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")
    every = rows.select("dataset", "doc_id", "embedding", names)
    cover = dist.coverage_metrics(every.withColumn("dataset", label), picked.withColumn("dataset", label))
    side_a = scores.select("dataset", names, F.col("score").alias("x"), F.lit("a").alias("side"))
    chosen_scores = sel.join_checked(scores, picked.select("dataset", "doc_id", "method"), ["dataset", "doc_id"])
    side_b = chosen_scores.select("dataset", "method", F.col("score").alias("x"), F.lit("b").alias("side"))
    shift = dist.two_sample_distances(side_a.unionByName(side_b), ["dataset", "method"])
    shift = shift.select(label.alias("label"), "dataset", "method", "wasserstein")
    return shift.join(cover.withColumnRenamed("dataset", "label"), "label").drop("label")


def norm_shift_report(rows: DataFrame, n: int, population: int | None = None, methods: Sequence[str] = tuple(VECTOR_METHODS)) -> DataFrame:
    """Per method: distance of the selection's vector norms from the population's, and their mean.

    The population is the whole table, or ``population`` random rows of it if a number is given.
    """
    pooled = rows.withColumn("dataset", F.lit("all"))
    if population is not None:
        pooled = sel.with_rows(sel.select_random(pooled, population).select("doc_id"), pooled)
    base = pin(pooled)
    chosen = sel.join_checked(base.select("doc_id", "embedding"), _chosen(base, n, methods), ["doc_id"])
    norm = F.round(vx.l2_norm(F.col("embedding")), 9)
    side_b = pin(chosen.select("method", norm.alias("x"), F.lit("b").alias("side")))
    names = F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")
    side_a = base.select(norm.alias("x"), F.lit("a").alias("side"), names)
    shift = dist.two_sample_distances(side_a.unionByName(side_b), ["method"]).select("method", "wasserstein")
    return shift.join(side_b.groupBy("method").agg(F.avg("x").alias("mean_norm")), "method")


def selection_timing(
    docs: DataFrame,
    methods: dict[str, Callable[[DataFrame], DataFrame]],
    fractions: Sequence[float] = (0.1, 0.25, 0.5, 1.0),
    at_least: int = 0,
) -> DataFrame:
    """Seconds each method takes on growing parts of the corpus."""
    parts = pin(sel.fraction_subset(docs, fractions, at_least))
    rows = []
    for fraction in fractions:
        part = parts.where(F.col("fraction") == fraction).drop("fraction")
        used = part.count()
        for method, run in methods.items():
            begin = time.perf_counter()
            chosen = run(part).count()
            rows.append((method, float(fraction), used, chosen, time.perf_counter() - begin))
    return docs.sparkSession.createDataFrame(
        rows, "method string, fraction double, n_used bigint, n_chosen bigint, selection_time_s double"
    )
