"""All-pairs work in blocks of bounded size, for results that have no closed form.

Rows are hashed to blocks of about ``block_rows`` rows; every pair of blocks becomes one group, to which
each of the two blocks is sent. A group computes its part of the matrix with numpy and gives back sums per
row, or only the pairs asked for; pairs themselves are never shuffled. The work stays quadratic in the
number of distinct rows, but no task and no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.operators.skew import join_checked

BLOCK_ROWS = 1024
VOCABULARY_SLICE = 8192


def pair_blocks(
    rows: DataFrame, row_id: str, kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str,
    keys: Sequence[str] = (), block_rows: int | None = None,
) -> DataFrame:
    """Apply ``kernel(left, right, same)`` to every unordered pair of blocks, within each group of ``keys``."""
    block_rows = block_rows or BLOCK_ROWS
    if keys:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
        sized = join_checked(rows, sizes, keys)
    else:
        sized = rows.withColumn("_blocks", F.lit(max(1, -(-rows.count() // block_rows))))
    own = F.pmod(F.xxhash64(F.lit("block"), row_id), F.col("_blocks")).cast("int")
    paired = (
        sized.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")})
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["_low"].iat[0], group["_high"].iat[0]
        left = group[group["_own"] == low].sort_values(row_id, ignore_index=True)
        if low == high:
            return kernel(left, left, True)
        return kernel(left, group[group["_own"] == high].sort_values(row_id, ignore_index=True), False)

    return paired.drop("_other", "_blocks").groupBy(*keys, "_low", "_high").applyInPandas(run, schema)


def _flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lengths = sets.map(len).to_numpy()
    items = np.concatenate([np.asarray(s, dtype=np.int64) for s in sets]) if len(sets) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(sets)), lengths), items


def overlaps(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of integers."""
    left_rows, left_items = _flat(left)
    right_rows, right_items = _flat(right)
    common = np.intersect1d(left_items, right_items)
    out = np.zeros((len(left), len(right)))
    if not len(common):
        return out
    keep_l, keep_r = np.isin(left_items, common), np.isin(right_items, common)
    left_rows, left_at = left_rows[keep_l], np.searchsorted(common, left_items[keep_l])
    right_rows, right_at = right_rows[keep_r], np.searchsorted(common, right_items[keep_r])
    for begin, end in slices(len(common)):
        a = np.zeros((len(left), end - begin), dtype=np.float32)
        b = np.zeros((len(right), end - begin), dtype=np.float32)
        in_l, in_r = (left_at >= begin) & (left_at < end), (right_at >= begin) & (right_at < end)
        a[left_rows[in_l], left_at[in_l] - begin] = 1
        b[right_rows[in_r], right_at[in_r] - begin] = 1
        out += a @ b.T
    return out


def slices(size: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, size, VOCABULARY_SLICE):
        yield begin, min(begin + VOCABULARY_SLICE, size)
