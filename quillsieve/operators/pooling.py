"""One vector per sequence from one vector per position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import vectors as vx


def masked_mean_pool(rows: DataFrame, keys: Sequence[str] = ("seq",), vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """Mean of the vectors whose mask is set; partial sums are merged, positions are not collected."""
    weights = F.array_repeat(F.col(mask).cast("double"), F.size(vector))
    weighted = F.zip_with(vector, weights, lambda x, m: x * m)
    sums = rows.groupBy(*keys).agg(vx.sum_vector(weighted).alias("_sum"), F.sum(mask).cast("double").alias("_n"))
    counts = F.array_repeat(F.greatest(F.col("_n"), F.lit(1e-9)), F.size("_sum"))
    return sums.withColumn(vector, F.zip_with("_sum", counts, lambda x, n: x / n)).drop("_sum", "_n")


def mean_pool(rows: DataFrame, keys: Sequence[str] = ("seq",), vector: str = "embedding") -> DataFrame:
    return rows.groupBy(*keys).agg(vx.mean_vector(F.col(vector)).alias(vector))


def flatten_vectors(rows: DataFrame, keys: Sequence[str] = ("seq",), vector: str = "embedding") -> DataFrame:
    """The vectors of a sequence, one after the other."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", vector)))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda e: e[vector])).alias(vector))
