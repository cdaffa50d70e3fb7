"""Singular values and directions of vector tables, from triangular factors that tasks make of their own rows.

A tall table X and the factor R of its QR decomposition have the same singular values and right singular vectors, and the
factor of stacked factors is that of the stacked rows. So every task reduces its rows to a factor of at most as many rows
as a vector has numbers, and factors are stacked ``FAN`` at a time until a dataset has one. Nothing is squared, and no
vector, factor or dataset name reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import vectors as vx
from quillsieve.session import pin

FAN = 4
# A task's buffered rows and factors; beyond, what it has is passed on, so many datasets or wide vectors do not add up.
BUFFER_BYTES = 256 << 20
_FACTORS = "dataset string, side int, part int, row array<double>"


def _factor(rows: np.ndarray) -> np.ndarray:
    """A matrix with the same singular values and directions and no more rows than columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _frame(dataset: str | None, side: int, part: int, rows: np.ndarray) -> pd.DataFrame:
    frame = pd.DataFrame({"row": list(rows)})
    return frame.assign(dataset=dataset, side=np.int32(side), part=np.int32(part))[["dataset", "side", "part", "row"]]


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    held: dict[tuple, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for (dataset, side), group in batch.groupby(["dataset", "side"], dropna=False):
            x = np.stack(group["embedding"].to_numpy())
            parts = held.setdefault((None if pd.isna(dataset) else dataset, side), [])
            parts.append(x)
            size += x.nbytes
            if sum(map(len, parts)) > 2 * x.shape[1]:
                size -= sum(p.nbytes for p in parts)
                parts[:] = [_factor(np.concatenate(parts))]
                size += parts[0].nbytes
        if size > BUFFER_BYTES:
            for (dataset, side), parts in held.items():
                yield _frame(dataset, side, part, _factor(np.concatenate(parts)))
            held, size = {}, 0
    for (dataset, side), parts in held.items():
        yield _frame(dataset, side, part, _factor(np.concatenate(parts)))


def _stacked(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    return _frame(first["dataset"], first["side"], first["part"], _factor(np.stack(group["row"].to_numpy())))


def factors(sides: list[DataFrame]) -> DataFrame:
    """``dataset, side, part, row``: the rows of one factor per dataset and table. Rows without a vector are left out."""
    whole = None
    for side, rows in enumerate(sides):
        vector = vx.as_doubles(F.col("embedding")).alias("embedding")
        rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("dataset", F.lit(side).alias("side"), vector)
        whole = rows if whole is None else whole.unionByName(rows)
    found = pin(whole.mapInPandas(_local, _FACTORS))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        found = found.groupBy("dataset", "side", "part").applyInPandas(_stacked, _FACTORS)
        parts = -(-parts // FAN)
    return found


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    s = np.linalg.svd(np.stack(group["row"].to_numpy()), compute_uv=False)
    share = s / s.sum() if s.sum() > 0 else s
    positive = share[share > 0]
    frobenius, nuclear, top = float(np.sqrt((s**2).sum())), float(s.sum()), float(s[0])
    return pd.DataFrame(
        {
            "dataset": [group["dataset"].iat[0]],
            "effective_rank": [float(np.exp(-(positive * np.log(positive)).sum()))],
            "stable_rank": [float((s**2).sum() / top**2) if top > 0 else 0.0],
            "spectral": [top],
            "nuclear": [nuclear],
            "frobenius": [frobenius],
            "spectral_share": [top / nuclear if nuclear > 0 else 0.0],
            "spectral_ratio": [top / frobenius if frobenius > 0 else 0.0],
        }
    )


def spectral_summary(rows: DataFrame) -> DataFrame:
    """Norms, ranks and ratios of each dataset's singular values."""
    return factors([rows]).groupBy("dataset").applyInPandas(
        _summary,
        "dataset string, effective_rank double, stable_rank double, spectral double, nuclear double, "
        "frobenius double, spectral_share double, spectral_ratio double",
    )


def subspace_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per dataset that both have, how much of the top ``k`` directions of ``a`` lies in those of ``b`` (0 to 1).

    A table of fewer than ``k`` rows has as many directions as rows.
    """

    def overlap(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if group["side"].nunique() == 2:
            u, v = (
                np.linalg.svd(np.stack(group.loc[group["side"] == side, "row"].to_numpy()), full_matrices=False)[2][:k]
                for side in (0, 1)
            )
            out = [(group["dataset"].iat[0], float(((u @ v.T) ** 2).sum() / len(u)))]
        return pd.DataFrame(out, columns=["dataset", "overlap"])

    return factors([a, b]).groupBy("dataset").applyInPandas(overlap, "dataset string, overlap double")
