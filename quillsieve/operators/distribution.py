"""How far a selection is from its corpus: divergences, distances between samples, coverage, curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsieve.functions import vectors as vx
from quillsieve.operators import counts as ct
from quillsieve.operators.ordering import running_totals
from quillsieve.operators.skew import join_checked
from quillsieve.session import pin

EPSILON = 1e-10
SAMPLE_CELLS = 16_000_000
EXACT_ROWS = 10_000


def kl_divergence(
    full: DataFrame, subsets: DataFrame, by: Sequence[str] = ("method",), groups: DataFrame | None = None
) -> DataFrame:
    """KL of the full counter against each subset counter over their united vocabulary, in nats.

    ``full``: token, n; ``subsets``: by..., token, n. A word missing from a subset has share ``EPSILON``
    before renormalisation. Words outside the subset contribute a constant, so only the subset's words are
    joined, not the whole vocabulary once per subset. ``groups`` lists the subsets that are asked for; one of them
    without any token is infinitely far.
    """
    full = pin(full.select("token", F.col("n").alias("full_n")))
    totals = full.agg(F.sum("full_n"), F.count(F.lit(1))).first()
    total, vocabulary = float(totals[0] or 0), totals[1]
    subsets = pin(subsets.select(*by, "token", "n"))
    sizes = subsets.groupBy(*by).agg(F.sum("n").alias("size"))
    p = F.col("full_n") / F.lit(total or 1.0)
    base = full.agg(F.sum(p * F.log(p / F.lit(EPSILON)))).first()[0] or 0.0
    joined = join_checked(subsets.join(full, "token", "left"), sizes, by)
    q = F.col("n") / F.col("size")
    closer = F.sum(F.coalesce(p * F.log((q + EPSILON) / EPSILON), F.lit(0.0)))
    unseen = F.sum(F.when(F.col("full_n").isNull(), 1).otherwise(0))
    found = joined.groupBy(*by).agg(closer.alias("closer"), unseen.alias("unseen"), F.max("size").alias("size"))
    if groups is not None:
        found = groups.select(*by).distinct().join(found, list(by), "left").fillna({"size": 0})
    value = F.lit(base) - F.col("closer") + F.log1p(F.lit(EPSILON) * (F.lit(vocabulary) + F.col("unseen")))
    empty = (F.col("size") == 0) | F.lit(total == 0)
    return found.select(*by, F.when(empty, F.lit(float("inf"))).otherwise(value).alias("kl"))


def zipf_curve(counts: DataFrame) -> DataFrame:
    """Share of the corpus by frequency rank, next to the ideal share at that rank."""
    ranked = pin(ct.rank_by_frequency(counts))
    sums = ranked.agg(F.sum("n").alias("total"), F.sum(F.lit(1.0) / F.col("rank")).alias("harmonic")).first()
    return ranked.select(
        "token",
        "n",
        "rank",
        (F.col("n") / F.lit(float(sums["total"] or 1))).alias("frequency"),
        (F.lit(1.0) / F.col("rank") / F.lit(sums["harmonic"] or 1.0)).alias("ideal"),
    )


def _merged(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both samples' distribution functions at every distinct value, with the value that follows."""
    side = [F.sum((F.col("side") == s).cast("bigint")).alias(f"n_{s}") for s in ("a", "b")]
    distinct = values.where(F.col("x").isNotNull()).groupBy(*keys, "x").agg(*side)
    summed = running_totals(distinct, [F.col("x")], ["n_a", "n_b"], keys, ahead="x")
    summed = pin(summed)
    totals = summed.groupBy(*keys).agg(F.max("cum_n_a").alias("total_a"), F.max("cum_n_b").alias("total_b"))
    joined = join_checked(summed, totals, keys)
    return joined.withColumns(
        {"cdf_a": F.try_divide("cum_n_a", "total_a"), "cdf_b": F.try_divide("cum_n_b", "total_b")}
    )


def two_sample_distances(
    values: DataFrame, keys: Sequence[str] = ("layer",), exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """Wasserstein distance, Kolmogorov-Smirnov statistic and its p-value per group.

    ``values``: keys..., x, side ('a' or 'b'). Samples are counted by distinct value first; running counts
    are summed per range of values. A group that holds one of the samples only has no distance (null). The p-value is exact
    if both samples have at most ``exact_rows`` values, else asymptotic.
    """
    gap = F.abs(F.col("cdf_a") - F.col("cdf_b"))
    found = _merged(values, keys).groupBy(*keys).agg(
        F.when(F.max(gap).isNotNull(), F.coalesce(F.sum(gap * (F.col("next_x") - F.col("x"))), F.lit(0.0))).alias("wasserstein"),
        F.max(gap).alias("ks"),
        F.max("total_a").alias("n_a"),
        F.max("total_b").alias("n_b"),
    )
    asymptotic = kolmogorov_p(F.col("ks"), F.col("n_a"), F.col("n_b"))
    if exact_rows <= 0:
        return found.withColumn("p_value", asymptotic)
    small = F.greatest("n_a", "n_b") <= exact_rows  # false for a large group, whose paths are not counted
    reach = F.when(small, F.round(F.col("ks") * F.col("n_a") * F.col("n_b")).cast("bigint"))
    exact = _exact_p(reach, F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    return found.withColumn("p_value", F.when(small, exact).otherwise(asymptotic))


def exact_p(reach: int, n_a: int, n_b: int) -> float:
    """Chance that two samples of one distribution, without ties, are at least ``reach / (n_a * n_b)`` apart.

    Every order of the united sample is equally likely and is a path from (0, 0) to (n_a, n_b). The chance of being at
    each point without having been ``reach`` apart goes diagonal by diagonal; what steps over the edge is summed, so
    small values keep their digits. Only the lanes between the edges are touched.
    """
    if reach <= 0:
        return 1.0
    m, n = sorted((int(n_a), int(n_b)))
    inside = np.zeros(m + 2)  # one lane more than there are points, always zero
    inside[0] = 1.0
    over = 0.0
    for step in range(m + n):
        low = max(0, (step * m - reach) // (m + n) - 1)
        high = min(m, (step * m + reach) // (m + n) + 2)
        i = np.arange(low, high + 1)
        here = inside[low : high + 1]
        left = m + n - step
        moved = np.zeros(len(i) + 1)
        moved[:-1] = here * (n - step + i) / left
        moved[1:] += here * (m - i) / left
        lanes = np.arange(low, high + 2)
        out = np.abs(lanes * n - (step + 1 - lanes) * m) >= reach
        over += moved[out].sum()
        moved[out] = 0.0
        inside[low : high + 2] = moved
    return float(min(over, 1.0))


@F.pandas_udf(T.DoubleType())
def _exact_p(reach: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    known = reach.notna()
    return pd.Series([exact_p(int(r), a, b) if k else None for r, a, b, k in zip(reach, n_a, n_b, known)], dtype=float)


def kolmogorov_p(ks: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic tail probability of the two-sample statistic."""
    scaled = ks * ks * n_a * n_b / (n_a + n_b)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(scaled * k * k * F.lit(-2.0)),
    )
    return F.when(scaled < 0.01, F.lit(1.0)).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def pair_describe(values: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Mean, extremes, skewness and excess kurtosis of both samples, and their differences."""
    columns = []
    for side in ("a", "b"):
        x = F.when(F.col("side") == side, F.col("x"))
        columns += [
            F.avg(x).alias(f"mean_{side}"),
            F.max(x).alias(f"max_{side}"),
            F.min(x).alias(f"min_{side}"),
            F.skewness(x).alias(f"skew_{side}"),
            F.kurtosis(x).alias(f"kurtosis_{side}"),
        ]
    described = values.groupBy(*keys).agg(*columns)
    return described.withColumns(
        {"mean_diff": F.col("mean_a") - F.col("mean_b"), "max_diff": F.col("max_a") - F.col("max_b")}
    )


def nearest_neighbor(rows: DataFrame, sample: DataFrame, cells: int = SAMPLE_CELLS) -> DataFrame:
    """Smallest cosine distance of each row to the sample of its dataset.

    The sample is shipped to the tasks in pieces of at most ``cells`` numbers; a sample of one piece, the
    usual case, takes one pass without a shuffle, a larger one keeps the running minimum between passes.
    """
    units = rows.select("dataset", "doc_id", vx.l2_normalize(vx.as_doubles(F.col("embedding"))).alias("unit"))
    picked = pin(sample.select("dataset", vx.l2_normalize(vx.as_doubles(F.col("embedding"))).alias("unit")))
    measured = picked.agg(F.count(F.lit(1)), F.max(F.size("unit"))).first()
    pieces = max(1, -(-(measured[0] or 0) * (measured[1] or 1) // cells))
    parts = picked.withColumn("piece", F.pmod(F.xxhash64("unit"), F.lit(pieces)))
    state = units.withColumn("distance", F.lit(None).cast("double"))
    for piece in range(pieces):
        local = parts.where(F.col("piece") == piece).select("dataset", "unit").toPandas()
        matrices = {d: np.stack(g.to_numpy()) for d, g in local.groupby("dataset")["unit"]}

        def lower(batches: Iterator[pd.DataFrame], matrices: dict = matrices) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch.reset_index(drop=True)
                distance = batch["distance"].to_numpy(dtype=float).copy()
                for dataset, at in batch.groupby("dataset").indices.items():
                    if dataset in matrices:
                        cos = np.stack(batch["unit"].to_numpy()[at]) @ matrices[dataset].T
                        distance[at] = np.fmin(distance[at], 1.0 - cos.max(axis=1))
                yield batch.assign(distance=distance)

        state = state.mapInPandas(lower, state.schema)
        if pieces > 1:
            state = pin(state)
    return state.select("dataset", "doc_id", "distance")


def coverage_metrics(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Mean and largest nearest-neighbour distance, and the cosine distance of the raw centroids, per dataset."""
    near = nearest_neighbor(rows, sample).groupBy("dataset").agg(
        F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")
    )
    whole = rows.groupBy("dataset").agg(vx.mean_vector(vx.as_doubles(F.col("embedding"))).alias("whole"))
    part = sample.groupBy("dataset").agg(vx.mean_vector(vx.as_doubles(F.col("embedding"))).alias("part"))
    centers = whole.join(part, "dataset").select(
        "dataset", (F.lit(1.0) - vx.cosine(F.col("whole"), F.col("part"))).alias("centroid_distance")
    )
    return near.join(centers, "dataset")


def ecdf(values: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Share of values up to and including each distinct value."""
    distinct = values.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    summed = pin(running_totals(distinct, [F.col(x)], ["n"], keys))
    totals = summed.groupBy(*keys).agg(F.max("cum_n").alias("total"))
    return join_checked(summed, totals, keys).select(*keys, x, (F.col("cum_n") / F.col("total")).alias("share"))


def histogram(values: DataFrame, keys: Sequence[str], bins: int, x: str = "x") -> DataFrame:
    """Counts and densities in ``bins`` equal bins between each group's extremes; the last bin is closed.

    A group of one value has one bin without a density.
    """
    known = values.where(F.col(x).isNotNull())
    spans = known.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("total"))
    joined = join_checked(known.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")), spans, keys)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(x) - F.col("lo"), width)), F.lit(bins - 1))
    binned = joined.withColumn("bin", F.when(width > 0, at).otherwise(F.lit(0)))
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("n"), F.max("total") * F.max(width)).alias("density")
    )


def density(values: DataFrame, keys: Sequence[str], points: int = 64, x: str = "x") -> DataFrame:
    """Gaussian kernel density on a grid between each group's extremes, bandwidth by Scott's rule."""
    known = values.where(F.col(x).isNotNull())
    spans = known.groupBy(*keys).agg(
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
        F.count(F.lit(1)).alias("total"),
        (F.stddev_samp(x) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("width"),
    )
    joined = join_checked(known.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")), spans.where("width > 0"), keys)
    grid = joined.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(points - 1)
    z = (at - F.col(x)) / F.col("width")
    mass = F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z))
    scale = F.max(F.col("total") * F.col("width") * F.lit(float(np.sqrt(2 * np.pi))))
    return grid.groupBy(*keys, "point").agg(F.max(at).alias("grid_x"), (mass / scale).alias("density"))


def mean_pairwise_similarity(rows: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean cosine over all pairs of different rows, from the length of the sum of the unit vectors."""
    unit = vx.l2_normalize(vx.as_doubles(F.col("embedding")))
    sums = rows.select(*keys, unit.alias("unit")).groupBy(*keys).agg(
        vx.sum_vector(F.col("unit")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    value = (vx.dot(F.col("s"), F.col("s")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(*keys, "n", F.when(F.col("n") > 1, value).alias("similarity"))
