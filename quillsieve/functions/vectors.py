"""Column functions over ``array<double>`` vectors, evaluated in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    lengths = F.array_repeat(F.greatest(l2_norm(a), F.lit(1e-12)), F.size(a))
    return F.zip_with(a, lengths, lambda x, length: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(1e-12))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def mean_vector(vector: Column) -> Column:
    """Aggregate: the component-wise mean, with partial sums before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def sum_vector(vector: Column) -> Column:
    """Aggregate: the component-wise sum."""
    return vector_to_array(Summarizer.sum(array_to_vector(vector)))
