"""Aggregates over layer values: running sums, weighted scores, masks, differences and top-k means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.functions import vectors as vx
from quillsieve.operators.ordering import global_index, group_percentile, top_n
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin


def running_sums(facts: DataFrame, keys: Sequence[str] = ("layer", "feature"), sample: str = "seq") -> DataFrame:
    """Mergeable sums per layer and feature: of x, x squared, and the norms of each sample's values."""
    per_sample = facts.groupBy(*keys, sample).agg(
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count(F.lit(1)).alias("tokens")
    )
    norm = F.sqrt(F.col("sq") + 1e-12)
    return per_sample.groupBy(*keys).agg(
        F.sum("sx").alias("sum_x"),
        F.sum("sq").alias("sum_sq"),
        F.sum(norm).alias("sum_l2"),
        F.sum(norm * norm).alias("sum_l2_sq"),
        F.count(F.lit(1)).alias("samples"),
        F.sum("tokens").alias("tokens"),
    )


def merge_sums(*parts: DataFrame, keys: Sequence[str] = ("layer", "feature")) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    names = ("sum_x", "sum_sq", "sum_l2", "sum_l2_sq", "samples", "tokens")
    return whole.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def finish_moments(sums: DataFrame) -> DataFrame:
    """Mean, variance, feature norm, and mean and deviation of the sample norms."""
    mean = F.col("sum_x") / F.col("tokens")
    mean_l2 = F.col("sum_l2") / F.col("samples")
    return sums.withColumns(
        {
            "mean": mean,
            "variance": F.greatest(F.col("sum_sq") / F.col("tokens") - mean * mean, F.lit(0.0)),
            "feature_norm": F.sqrt(F.col("sum_sq") + 1e-12),
            "mean_l2": mean_l2,
            "std_l2": F.sqrt(F.greatest(F.col("sum_l2_sq") / F.col("samples") - mean_l2 * mean_l2, F.lit(0.0))),
        }
    )


def second_moment(facts: DataFrame, keys: Sequence[str] = ("layer", "feature")) -> DataFrame:
    """Second moment weighted by tokens, its root, and the largest absolute value."""
    return facts.groupBy(*keys).agg(
        F.avg(F.col("x") * F.col("x")).alias("second_moment"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"),
        F.max(F.abs("x")).alias("max_abs"),
    )


def weighted_scores(weights: DataFrame, scales: DataFrame, keys: Sequence[str] = ("module",)) -> DataFrame:
    """|w| times the root of its column's scale. ``weights``: keys, row, col, w; ``scales``: keys, col, s."""
    joined = join_checked(weights, scales, [*keys, "col"])
    return joined.select(*keys, "row", "col", (F.abs("w") * F.sqrt("s")).alias("score"))


def describe_layer(scores: DataFrame, activations: DataFrame, keys: Sequence[str] = ("method", "layer")) -> DataFrame:
    """Extremes, mean and median of scores and of activations, and the population variance of the latter."""

    def summary(rows: DataFrame, name: str, *more: Column) -> DataFrame:
        found = rows.groupBy(*keys).agg(
            F.max("x").alias(f"{name}_max"), F.avg("x").alias(f"{name}_mean"), F.min("x").alias(f"{name}_min"), *more
        )
        return found.join(group_percentile(rows, keys, "x", 0.5, f"{name}_median"), list(keys))

    return summary(scores, "score").join(
        summary(activations, "activation", F.var_pop("x").alias("activation_var")), list(keys)
    )


def topk_mean(values: DataFrame, k: float, key: str = "layer", x: str = "x", row_id: Sequence[str] = ()) -> DataFrame:
    """Mean of each layer's largest values: ``k`` of them, or that share of them if below one."""
    narrow = values.select(key, x, *row_id)
    if k >= 1:
        best = top_n(narrow, [F.col(x).desc(), *[F.col(c) for c in row_id]], int(k), [key])
        return best.groupBy(key).agg(F.avg(x).alias("topk_mean"), F.count(F.lit(1)).alias("k"))
    placed = pin(global_index(narrow, [F.col(x).desc(), *[F.col(c) for c in row_id]], [key], "place", 1))
    limits = placed.groupBy(key).agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(k)), F.lit(1)).alias("limit"))
    kept = join_checked(placed, limits, [key]).where(F.col("place") <= F.col("limit"))
    return kept.groupBy(key).agg(F.avg(x).alias("topk_mean"), F.count(F.lit(1)).alias("k"))


def mask_overlap(a: DataFrame, b: DataFrame, sparsity: float, keys: Sequence[str] = ("module",)) -> DataFrame:
    """Share of kept cells that two score matrices agree on, keeping the best columns of each row.

    The kept number of columns is the same in each row: columns times (1 - sparsity), at least one.
    """
    columns = pin(a.groupBy(*keys).agg((F.max("col") + 1).alias("cols")))
    keep = columns.withColumn("k", F.greatest(F.floor(F.col("cols") * F.lit(1 - sparsity)), F.lit(1)))

    def kept(scores: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys, "row").orderBy(F.col("score").desc(), "col"))
        ranked = join_checked(scores.select(*keys, "row", "col", place.alias("place")), keep, keys)
        return ranked.where(F.col("place") <= F.col("k")).select(*keys, "row", "col", "k")

    left, right = kept(a), kept(b).drop("k").withColumn("hit", F.lit(1))
    both = left.join(right, [*keys, "row", "col"], "left")
    share = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))
    return both.groupBy(*keys).agg(share.alias("overlap"), F.count(F.lit(1)).alias("kept"))


def diff_vs_reference(stats: DataFrame, reference: str, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Each method's mean against the reference method's. ``stats``: method, keys, mean, variance."""
    base = stats.where(F.col("method") == reference).select(
        *keys, F.col("mean").alias("ref_mean"), F.col("variance").alias("ref_variance")
    )
    joined = stats.where(F.col("method") != reference).join(base, list(keys))
    d = F.col("mean") - F.col("ref_mean")
    return joined.select(
        "method",
        *keys,
        d.alias("diff"),
        F.sqrt(d * d + F.col("variance") + F.col("ref_variance")).alias("spread"),
        (d / (F.abs("ref_mean") + 1e-8)).alias("relative"),
    )


def diff_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("method").agg(
        F.avg("diff").alias("mean_diff"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse")
    )


def median_rel_diff(diffs: DataFrame) -> DataFrame:
    """Median relative difference per method, with the clip limit: the 95th percentile of its size."""
    sized = diffs.withColumn("size", F.abs("relative"))
    medians = group_percentile(sized, ["method"], "relative", 0.5, "median_relative")
    return medians.join(group_percentile(sized, ["method"], "size", 0.95, "clip"), "method")


def layer_cosine(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("layer",), on: str = "pos") -> DataFrame:
    """Mean cosine of the vectors at the same place of two tables, per layer."""
    right = b.select(*keys, on, F.col("vector").alias("other"))
    joined = a.join(right, [*keys, on])
    return joined.groupBy(*keys).agg(F.avg(vx.cosine(F.col("vector"), F.col("other"))).alias("cosine"))


def layer_range(rows: DataFrame, n: int, last: bool = True, index: str = "layer_no") -> DataFrame:
    """Rows of the last (or first) ``n`` distinct layers."""
    order = F.col(index).desc() if last else F.col(index).asc()
    kept = rows.select(index).distinct().orderBy(order).limit(n)
    return join_checked(rows, kept, [index], "left_semi")


def pick_first_mid_last(layers: DataFrame, name: str = "layer") -> DataFrame:
    """The first, middle and last layer by name; all if there are fewer than three."""
    placed = pin(global_index(layers.select(name).distinct(), [F.col(name)], name="rank", start=1))
    total = placed.count()
    wanted = [1, total // 2 + 1, total] if total >= 3 else [1, 2]
    return placed.where(F.col("rank").isin(*wanted))


def layer_sequence(rows: DataFrame, keys: Sequence[str] = ("dataset", "method"), name: str = "layer") -> DataFrame:
    """Zero-based place of each layer name within its dataset and method."""
    names = rows.select(*keys, name).distinct()
    return global_index(names, [F.col(name)], keys, "layer_idx")


def pair_stats_join(stats: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Statistics of two methods side by side, for a list of method pairs."""
    names = stats.sparkSession.createDataFrame(list(pairs), "method_a string, method_b string")
    values = [c for c in stats.columns if c not in ("method", *keys)]
    left = stats.select(F.col("method").alias("method_a"), *keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = stats.select(F.col("method").alias("method_b"), *keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(F.broadcast(names), "method_a").join(right, ["method_b", *keys])
