"""The exact two-sample p-value against all orders of the united sample."""

from __future__ import annotations

import itertools

import pytest

from quillsieve.operators import distribution as dist


@pytest.mark.parametrize(("m", "n"), [(1, 1), (1, 4), (3, 3), (4, 6), (5, 2)])
def test_all_orders_of_small_samples(m, n):
    widest = []
    for firsts in itertools.combinations(range(m + n), m):
        i = j = most = 0
        for at in range(m + n):
            i, j = (i + 1, j) if at in firsts else (i, j + 1)
            most = max(most, abs(i * n - j * m))
        widest.append(most)
    for reach in {0, *widest}:
        expected = sum(w >= reach for w in widest) / len(widest)
        assert dist.exact_p(reach, m, n) == pytest.approx(expected, rel=1e-12)


def test_far_samples_keep_their_digits():
    # only two of all orders separate the samples
    assert dist.exact_p(40 * 40, 40, 40) == pytest.approx(2 / 107507208733336176461620, rel=1e-9)


def test_large_samples_come_near_the_limit(spark):
    from pyspark.sql import functions as F

    limit = spark.range(1).select(dist.kolmogorov_p(F.lit(0.02), F.lit(10_000), F.lit(10_000))).first()[0]
    assert dist.exact_p(2_000_000, 10_000, 10_000) == pytest.approx(limit, rel=0.02)


def test_only_small_groups_are_exact(spark):
    rows = [("s", float(i), "a" if i % 3 else "b") for i in range(9)] + [("one", 1.0, "a")]
    values = spark.createDataFrame(rows, "layer string, x double, side string")
    exact = {r.layer: r.p_value for r in dist.two_sample_distances(values).collect()}
    limit = {r.layer: r.p_value for r in dist.two_sample_distances(values, exact_rows=5).collect()}
    assert exact["one"] is None and limit["one"] is None
    assert exact["s"] == pytest.approx(dist.exact_p(6, 6, 3))
    assert limit["s"] != exact["s"]
