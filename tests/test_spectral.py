"""Singular values and directions against numpy, however the rows are dealt."""

from __future__ import annotations

import numpy as np
import pytest

from quillsieve.operators import spectral

SCHEMA = "dataset string, embedding array<double>"


def frame(spark, data, parts):
    rows = [(d, [float(x) for x in v]) for d, x in data.items() for v in x]
    return spark.createDataFrame(rows + [("a", None)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def data():
    chance = np.random.default_rng(6)
    tall = chance.normal(size=(700, 12)) @ np.diag(np.geomspace(1, 1e-6, 12))
    return {"a": tall, "b": chance.normal(size=(5, 40)), None: chance.normal(size=(60, 7)), "zero": np.zeros((4, 3))}


@pytest.mark.parametrize("parts, buffer", [(1, 1 << 28), (11, 1 << 28), (6, 2000)])
def test_summary(spark, data, monkeypatch, parts, buffer):
    monkeypatch.setattr(spectral, "BUFFER_BYTES", buffer)
    got = {r["dataset"]: r for r in spectral.spectral_summary(frame(spark, data, parts)).collect()}
    assert got.keys() == data.keys()
    for dataset, x in data.items():
        s = np.linalg.svd(x, compute_uv=False)
        r = got[dataset]
        assert r["spectral"] == pytest.approx(s[0]) and r["nuclear"] == pytest.approx(s.sum())
        assert r["frobenius"] == pytest.approx(np.linalg.norm(x))
        if s[0] > 0:
            p = s / s.sum()
            assert r["effective_rank"] == pytest.approx(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
            assert r["stable_rank"] == pytest.approx((s**2).sum() / s[0] ** 2)
            assert r["spectral_share"] == pytest.approx(p[0]) and r["spectral_ratio"] == pytest.approx(s[0] / np.linalg.norm(x))
        else:
            assert r["effective_rank"] == pytest.approx(1.0) and r["stable_rank"] == r["spectral_ratio"] == 0.0


def test_small_values_keep_their_digits(spark, data):
    rows = spectral.factors([frame(spark, {"a": data["a"]}, 9)]).collect()
    assert len(rows) == 12
    got = np.linalg.svd(np.array([r["row"] for r in rows]), compute_uv=False)
    assert got == pytest.approx(np.linalg.svd(data["a"], compute_uv=False), rel=1e-9)


@pytest.mark.parametrize("parts", [1, 7])
def test_directions(spark, data, parts):
    chance = np.random.default_rng(8)
    other = {d: x[: max(3, len(x) // 2)] + 0.1 * chance.normal(size=x[: max(3, len(x) // 2)].shape) for d, x in data.items() if d != "zero"}
    found = spectral.subspace_overlap(frame(spark, data, parts), frame(spark, other, parts), 3)
    got = {r["dataset"]: r["overlap"] for r in found.collect()}
    assert got.keys() == other.keys()
    for d, y in other.items():
        u, v = np.linalg.svd(data[d])[2][:3], np.linalg.svd(y)[2][:3]
        assert got[d] == pytest.approx(((u @ v.T) ** 2).sum() / 3)


def test_wide_vectors_and_no_rows(spark):
    wide = np.random.default_rng(9).normal(size=(6, 5000))
    got = spectral.spectral_summary(frame(spark, {"w": wide}, 3)).collect()
    assert [r["nuclear"] for r in got] == [pytest.approx(np.linalg.svd(wide, compute_uv=False).sum())]
    assert spectral.spectral_summary(spark.createDataFrame([], SCHEMA)).collect() == []
